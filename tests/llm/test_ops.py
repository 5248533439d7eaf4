"""The corpus operators against brute force, and on nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter
from itertools import combinations
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import DATA
from tessera.llm import chat, decontaminate, html_crf, langid, licences, pieces, quality, repair, simhash, token_counts, transducer

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ODD = [(1, "the a b c"), (2, None), (3, ""), (4, " \t\n"), (5, LONG), (6, "the a b c"), (6, "the a b c"), (None, "x y"), (7, "é 日本 ☃️ ́ a\x00b"), (8, "x\n\nx\n \ny  z")]


def docs(spark, rows=ODD):
    """Texts with extra columns whose names operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("src0").alias("source"), F.length("text").cast("long").alias("n_chars"), F.lit(1).alias("_t"), F.lit(2).alias("_fp"), F.lit(3).alias("digest"), F.lit(4).alias("_spans"), F.lit(5).alias("kept"))


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(real):
    return {r.doc_id: r.text for r in real.select("doc_id", "text").collect()}


def test_quality_counts_equal_brute_force(spark, texts):
    rows = ODD + [(100 + k, v) for k, v in list(texts.items())[:40]] + [(900, "a b c a b c a"), (901, "a\na\n\na\n\n")]
    got = {}
    for r in quality.report(docs(spark, rows)).collect():
        got.setdefault(r.doc_id, r)
    for i, t in rows:
        w = SPACE.findall(t or "")
        tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if SPACE.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_quality_on_empty_table_and_stage_columns(spark, real):
    assert quality.report(docs(spark, [])).count() == 0
    d = real.withColumn("_t", F.lit(1)).withColumn("_row", F.lit(2))
    kept = quality.keep_good(d)
    assert kept.columns == d.columns and 0 < kept.count() < d.count()


def test_quality_keeps_good_and_drops_junk(spark, real):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    r = quality.report(real).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    rate = {x.quality: x.k for x in r}
    assert rate[1] > 0.95 and rate.get(0, 0) < 0.2


def test_quality_leaves_other_languages_unjudged(spark, real):
    far = "これは日本語の長い文章です " * 3 + " ".join(f"語{k} 文{k * 7} 話{k * 3}" for k in range(200))
    rows = spark.createDataFrame([(1, far, "ja"), (2, far, "en"), (3, far, None)], "doc_id long, text string, lang string")
    refs = quality.references(real)
    assert {r.doc_id: r.kept for r in quality.report(rows, refs=refs).collect()} == {1: True, 2: False, 3: False}
    assert {r.doc_id for r in quality.keep_good(rows, refs=refs).collect()} == {1}


def test_licences(spark):
    mit = licences.KNOWN[0][1]
    rows = [(1, "Copyright (c) 2020 A\n" + mit.upper().replace(".", " ;")), (2, mit + " x"), (3, None), (4, "."), (5, "text\nReleased under the MIT LICENCE!\nLicensed under CC BY-NC 4.0"), (6, ""), (6, "")]
    got = {}
    for r in licences.scan(docs(spark, rows)).collect():
        got[r.doc_id] = (r.license_id, r.n_license_lines, r.line_licenses)
    twice = licences.scan(docs(spark, rows[4:5] * 3 + rows[:1])).collect()
    assert Counter((r.doc_id, r.license_id, r.n_license_lines) for r in twice) == {(5, None, 2): 3, (1, "MIT", 0): 1}
    assert got == {1: ("MIT", 0, ""), 2: (None, 0, ""), 3: (None, 0, ""), 4: (None, 0, ""), 5: (None, 2, "CC-BY-NC-4.0,MIT"), 6: (None, 0, "")}
    own = spark.createDataFrame([("own", "Some  licence, text")], "license_id string, text string")
    assert licences.scan(docs(spark, [(1, "some license text")]), own).first().license_id == "own"
    assert licences.scan(docs(spark, [])).count() == 0 and licences.scan(docs(spark)).count() == len(ODD)


def test_licences_of_common_texts_and_lines_of_any_words(spark):
    folder = Path(licences.__file__).with_name("licence_texts")
    assert {p.name for p in folder.iterdir()} == set(licences.TEXTS)
    names = [*licences.TEXTS]
    whole = [(folder / n).read_text(encoding="utf-8") for n in names]
    rows = [(k, t) for k, t in enumerate(whole)] + [(100 + k, "\n".join(x.strip(" ") for x in t.upper().split("\n"))) for k, t in enumerate(whole)]
    rows += [(200 + k, t.split("END OF TERMS AND CONDITIONS")[0]) for k, t in enumerate(whole)]
    got = {r.doc_id: r.license_id for r in licences.scan(docs(spark, rows)).collect()}
    assert got == {100 * m + k: licences.TEXTS[n] for m in range(3) for k, n in enumerate(names)}
    body = licences._BSD2.replace("\n", " ")
    r = licences.scan(docs(spark, [(1, f"one\n{body}\n\n--\ntwo")])).first()
    assert (r.license_id, r.n_license_lines, r.line_licenses) == (None, 1, "BSD-2-Clause")
    own = spark.createDataFrame([("own", "Use it as you like.")], "license_id string, text string")
    r = licences.scan(docs(spark, [(1, "a\nuse it, as you like\nb\nUse it as you like!")]), own).first()
    assert (r.license_id, r.n_license_lines, r.line_licenses) == (None, 2, "own")


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><div class="cookie-consent">We use cookies. Accept.</div><header><a href="/">Site</a></header>
<nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><div class="ad">Buy this now, cheap.</div><article><h1>Head &amp; line</h1><p>First paragraph of the text, with a
 <b>bold</b> word, and more.<br>Then on.<p>Second paragraph, not closed. It goes on &lt;for&gt; a while.<script>var x = "</p>";</script></article>
<section class="comments"><h3>Comments</h3><div><p>Reader: what a fine piece of text this is, I think.</p></div></section><aside class="sidebar"><a href="/c">C</a></aside><form><label>Mail</label><input></form><footer>&copy; Site. All rights.</footer></body></html>"""


def test_html_main_text(spark):
    want = "Head & line First paragraph of the text, with a bold word, and more. Then on. Second paragraph, not closed. It goes on <for> a while."
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>" * 3000 + "</div>"), (5, "u", "< a & b <!-- x"), (5, "u", "< a & b <!-- x")]
    got = html_crf.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 6 and by[1].text == want and by[1].n_chars == len(want) and by[2].text == "" == by[3].text


def test_html_held_out_accuracy(spark):
    f = html_crf.model()
    pages = html_crf.labelled_pages(200, 77)
    pairs = [(a, b) for p, y in pages for a, b in zip(f.label(p), y)]
    assert sum(a == b for a, b in pairs) / len(pairs) > 0.99
    real = spark.read.parquet(f"{DATA}/pages.parquet").toPandas()
    for h in real.html:
        a = re.sub(r"<br>", " ", re.search(r"<article>(.*?)</article>", h, re.S)[1])
        a = re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1)>", "\n", a))
        assert f.text(h) == " ".join(html_crf.html.unescape(a).split())


FOREIGN = [
    ("<p>One paragraph of an article that stands by itself here.</p>", None),
    ("<div><p>First paragraph of text.</p><p>Second paragraph, with more.</p></div>", "First paragraph of text. Second paragraph, with more."),
    ("just text, without any element", None),
    ("<body><h1>A title</h1>Text in the body, and then<br>another line.<p>Then a paragraph.</body>", "A title Text in the body, and then another line. Then a paragraph."),
    ("<table><tr><td><p>Old pages put text into cells.</p><p>They have no cues at all.</p></td></tr></table>", "Old pages put text into cells. They have no cues at all."),
    ("<div><a href=a>Home</a> <a href=b>News</a></div><div>Here is the text of a page, written down in a box.</div><div>It goes on in another box, for a while.</div>", "Here is the text of a page, written down in a box. It goes on in another box, for a while."),
    ("<center><font>Text in a frame of old elements, two sentences. Here is the other.</font></center>", "Text in a frame of old elements, two sentences. Here is the other."),
    ("<x-app><x-card><p>Custom elements hold this text, and that is all.</p></x-card></x-app>", "Custom elements hold this text, and that is all."),
]


#: Inside an article, between two paragraphs: what has to be in its text.
INSIDE = [
    ("<p>The value <math><mi>x</mi></math> is known</p>", "The value x is known"),
    ("<p>A sum x<math><semantics><mi>y</mi><annotation encoding='tex'>zz</annotation></semantics></math>z of it.</p>", "A sum xyz of it."),
    ("<p>Press <button>Save</button> to keep</p>", "Press Save to keep"),
    ("<p>Press (<button class=b>Save</button>), then go on.</p>", "Press (Save), then go on."),
    ("<p>One <span class='ad sponsored'>Buy now cheap</span> two words.</p>", "One two words."),
    ("<p>One <span class='ad'>Buy <span>now</span> <a href=x>here</a></span> two words.</p>", "One two words."),
    ("<p>glue<span class='ad'>Buy</span>d on to it, all of it.</p>", "glued on to it, all of it."),
    ("<p>In the text <span class='ad'>Buy <p>Next paragraph goes on here, with words.</p>", "In the text Next paragraph goes on here, with words."),
    ("<p>Fish <svg><title>t</title></svg>swim in it.</p>", "Fish swim in it."),
    ("<ul><li><a href=1>Paper one</a></li><li><a href=2>Paper two</a></li></ul>", "Paper one Paper two"),
    ("<h2>References</h2><ol><li><a href=1>A first paper</a></li><li><a href=2>A second paper on it</a></li></ol>", "References A first paper A second paper on it"),
    ("<div class='share'><button>Share</button> <button>Like it</button></div>", ""),
    ("<div class='newsletter'><p>Get our news by mail.</p><button>Subscribe</button></div>", ""),
]


@pytest.mark.parametrize("inside, want", INSIDE)
def test_html_inside_an_article(inside, want):
    around = "First paragraph of the text, a long one, with words.", "Last paragraph of the text, with more words in it."
    page = f"<html><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><article><h1>Title of it</h1><p>{around[0]}</p>{inside}<p>{around[1]}</p></article><footer>&copy; Site</footer></body></html>"
    assert html_crf.model().text(page) == " ".join(x for x in ("Title of it", around[0], want, around[1]) if x)


def test_html_of_other_shapes_is_not_lost():
    f = html_crf.model()
    for page, want in FOREIGN:
        assert f.text(page) == (want or re.sub("<[^>]+>", "", page)), page


def test_html_weights_are_those_of_the_grammar():
    again, f = html_crf.trained(), html_crf.model()
    assert set(again.index) == set(f.index)
    pages = html_crf.labelled_pages(100, 99)
    assert [again.label(p) for p, _ in pages] == [f.label(p) for p, _ in pages]


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x", '<a "<b \'' * 40_000, "<svg>" * 40_000, "<" * 200_000, '<a href="x>y \'' * 40_000, "<div>" * 40_000 + "</span></p></foo>" * 40_000, "<!--" * 50_000, "<style>" * 9999, "<p class=" * 30_000, "<button>x" * 40_000, "<p><b class=ad>x" * 30_000 + "</b>" * 30_000])
def test_html_time_is_linear(page):
    began = time.process_time()
    html_crf.model().text(page)
    assert time.process_time() - began < 10


def test_html_of_an_empty_table(spark):
    assert html_crf.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_viterbi_equals_enumeration():
    f = html_crf.model()
    for p, _ in html_crf.labelled_pages(30, 5):
        p = p[:8]
        e = [sum(f.emit[f.index[x]] for x in fs if x in f.index) for fs in html_crf.features(p)]
        score = lambda y: f.start[y[0]] + sum(e[k][v] for k, v in enumerate(y)) + sum(f.step[a][b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        best = max(score(y) for y in np.ndindex(*[2] * len(p)))
        assert abs(score(f.label(p)) - best) < 1e-9


@pytest.fixture(scope="module")
def model():
    with open(PIECES, "rb") as f:
        return pieces.Pieces(f.read())


@pytest.fixture(scope="module")
def unigram():
    """The same file read as a unigram model."""
    with open(PIECES, "rb") as f:
        m = pieces.Pieces(f.read())
    m.merges = False
    return m


def short_texts(texts):
    r = random.Random(4)
    made = ["", " ", "  a", "a  b ", "\n", "日本語 x☃", "é́", "a▁b", "    ", "<s> </s>", "\x00"]
    for t in list(texts.values())[:60]:
        k = r.randrange(max(1, len(t)))
        made.append(t[k : k + 25])
    return made


def test_transducer_equals_the_library(model, texts):
    import sentencepiece as spm

    library, t = spm.SentencePieceProcessor(model_file=PIECES), transducer.Transducer(model)
    for x in [*short_texts(texts), *texts.values(), "hahahaha" * 9, "12345678901234567890", "https://example.com/a?b=1"]:
        got = t.encode(x).tolist()
        assert got == library.encode(x), x
        assert t.decode(got) == x.replace("▁", " ")


def test_a_chunk_is_not_searched_from_each_of_its_characters(model, texts):
    """The lexicon is entered less than once for each character of a chunk, and the paths are those of the pass over all positions."""

    class Root(dict):
        entered = 0

        def get(self, ch):
            self.entered += 1
            return super().get(ch)

    t = transducer.Transducer(model)
    t.arcs = root = Root(t.arcs)
    found = {c for x in [*texts.values()][:40] for c in pieces.chunks(model.normalised(x)) if len(c) > 3}
    paths = {c: t.path(c) for c in found}
    assert root.entered < 0.8 * sum(map(len, found))
    assert all(t.merge_path(c) == p for c, p in paths.items())


def made_model(kind, rule, fallback, prefix=True):
    """A small model file put together by hand: its vocabulary is given, its map of characters is the library's of that name."""
    import sentencepiece as spm
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(spm.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    m.normalizer_spec.add_dummy_prefix = prefix
    m.normalizer_spec.escape_whitespaces = True
    m.normalizer_spec.remove_extra_whitespaces = rule != "identity"
    m.trainer_spec.model_type = kind
    m.trainer_spec.byte_fallback = fallback
    del m.pieces[:]
    add = lambda piece, score, type_=1: m.pieces.add(piece=piece, score=score, type=type_)
    add("<unk>", 0, 2), add("<s>", 0, 3), add("</s>", 0, 3)
    for b in range(256 if fallback else 0):
        add(f"<0x{b:02X}>", 0, 6)
    r = random.Random(5)
    words = ["▁" + w for w in "the then there he her here en er re th".split()] + "the he er re en th hen ere".split()
    for k, w in enumerate([*words, *"▁ t h e r n a b c".split()]):
        add(w, -float(k) if kind == 2 else -r.uniform(2, 9) - (4 if len(w) == 1 else 0))
    return m.SerializeToString()


@pytest.mark.parametrize("kind", [1, 2])
@pytest.mark.parametrize("rule", ["identity", "nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("fallback", [True, False])
def test_transducer_equals_the_library_on_made_models(kind, rule, fallback):
    import sentencepiece as spm

    data = made_model(kind, rule, fallback)
    library, t = spm.SentencePieceProcessor(model_proto=data), transducer.Transducer(pieces.Pieces(data))
    r = random.Random(7)
    texts = ["".join(r.choice("therenabc  \tＴＨÉéﬁ①ß日☃\u200b\u00a0") for _ in range(r.randrange(0, 30))) for _ in range(300)] + ["", " ", "   ", "the  then ", " there", "ｔｈｅ　ｒｅ", "x" * 9]
    for x in texts:
        assert t.encode(x).tolist() == library.encode(x), repr(x)


def test_counter_equals_the_library(unigram, texts):
    from tokenizers import models

    lib = models.Unigram([(n, unigram.score.get(n, 0.0) if n in unigram.score else -2e9) for n in unigram.names], 0, True)
    c = token_counts.Counter(unigram)
    for x in [v for v in short_texts(texts) if v.isascii() and v.strip() and "  " not in v and "\x00" not in v and "<" not in v]:
        assert c.text(x)[0] == len(lib.tokenize(unigram.normalised(x))), x


def brute_path(model, s):
    """All positions, all pieces, exact sums; earliest start on ties."""
    best = [(0.0, [])] + [None] * len(s)
    for end in range(1, len(s) + 1):
        for start in range(max(0, end - model.longest), end):
            if s[start:end] in model.score:
                w, ids = best[start][0] + model.score[s[start:end]], [model.id[s[start:end]]]
            elif end - start == 1:
                w, ids = best[start][0] + model.unknown_score, [model.bytes[b] for b in s[start:end].encode()]
            else:
                continue
            if best[end] is None or w > best[end][0]:
                best[end] = (w, best[start][1] + ids)
    return best[-1]


def test_transducer_and_counter_equal_brute_force_on_whole_texts(unigram, texts):
    model = unigram
    t, c = transducer.Transducer(model), token_counts.Counter(model)
    for x in [*short_texts(texts), *[v for v in texts.values() if len(v) < 1500][:25]]:
        score, ids = brute_path(model, model.normalised(x))
        assert t.encode(x).tolist() == ids
        assert c.text(x) == (len(ids), score)


def test_encode_decode_and_counts_agree(spark, texts):
    enc = transducer.encode(docs(spark), PIECES).collect()
    cnt = token_counts.count(docs(spark), PIECES).collect()
    key = lambda r: (r.doc_id or -1, r.n_chars)
    assert len(enc) == len(ODD) and sorted(map(key, enc)) == sorted(map(key, cnt)) and all(r.round_trip for r in enc)
    back = transducer.decode(transducer.encode(docs(spark), PIECES), PIECES)
    assert Counter(r.text for r in back.collect()) == Counter(t or "" for _, t in ODD)
    assert transducer.encode(docs(spark, []), PIECES).count() == 0 == token_counts.count(docs(spark, []), PIECES).count()


def test_repair_round_trip_and_contract(spark, texts):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(BPE)
    rows = [(i, t) for i, t in ODD if i is not None] + [(100 + k, v) for k, v in list(texts.items())[:50]] + [(2000, "a  b"), (2001, "a   b \n c"), (2002, " lead! 'tis"), (2003, "x \ny.\nZ's"), (2004, "<|endoftext|>!"), (2005, "a.\n\nB 12,5 c d 　e")]
    got = repair.round_trip(docs(spark, rows), BPE).collect()
    at = 0
    for r, (i, t) in zip(sorted(got, key=lambda r: (r.start)), sorted(rows, key=lambda r: (r[0], r[1] or ""))):
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes())), i
        at += len(ids)
    assert repair.round_trip(docs(spark, []), BPE).count() == 0
    assert repair.round_trip(docs(spark), BPE).count() == len(ODD)


def test_repair_ids_of_texts_with_nul():
    with open(BPE, encoding="utf-8") as f:
        e = repair.Encoder(f.read())
    rows = ["abc", " \0abc", " \0 ", " \0", "\0abc", "x \0abc \0", "abc d\n\0e", "\0", "x \0\nabc", "a \0b", " \0b x", "a \0", "\0 \0", "x<|endoftext|>y z", "<|endoftext|>", "don't we'll it' 's", "été Ünï×à naïve!? ß", "é\nà.\nb", "x" * 500 + " y", "a\x1cb \x1cc", "a\xa0b \u3000c", "a\n\nb c", "\n\nb", "a\n\n\nb", "a\n", "a\n\n", "\n", "", "a, \nb", "a\n b", "x.\n-y"]
    from tokenizers import Tokenizer

    untouched = Tokenizer.from_file(BPE)
    for _ in range(2):  # with an empty cache and a filled one
        for t, ids in zip(rows, e.batch(pa.array(rows))):
            assert ids.tolist() == untouched.encode(t, add_special_tokens=False).ids, repr(t)


def test_repair_settles_overlaps_exactly():
    assert repair._settle(np.array([0, 1, 2]), np.array([3, 2, 1])).tolist() == [0, 2]
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randrange(1, 40)
        place = sorted(rng.sample(range(50), n))
        rank = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in place]
        taken = set()
        for r, p in sorted(zip(rank, place)):
            if not {p - 1, p + 1} & taken:
                taken.add(p)
        assert [place[k] for k in repair._settle(np.array(place), np.array(rank))] == sorted(taken)


@pytest.mark.parametrize("base", [300, 65_500, 70_000])
def test_repair_goes_on_while_rules_pay(base):
    rng = np.random.default_rng(3)
    passage = rng.integers(1, base, 400)
    mixed = np.concatenate([x for k in range(3000) for x in (passage, rng.integers(1, base, 3), [0])] + [rng.integers(1, 60, 40_000), np.full(5000, 7), [0]])
    symbols, rules = repair.replace_pairs(mixed, base)
    lengths = repair.rule_lengths(rules, base)
    assert lengths.max() >= 400 and len(symbols) < 3000 * 6 + 40_000
    flat = [x for x in symbols.tolist()]
    counts, k = Counter(), 0
    for k in range(len(flat) - 1):  # no pair is left that pays: without overlaps
        if flat[k] and flat[k + 1]:
            counts[flat[k], flat[k + 1]] += 1
    width = 2 if base + len(rules) < 1 << 16 else 3
    full = base < 1 << 16 == base + len(rules)
    assert full or all(n * width <= 12 for (a, b), n in counts.items() if a != b)
    sizes = np.diff(np.r_[-1, np.flatnonzero(mixed == 0)])
    s = repair.Shard(repair.pack(mixed, sizes))
    assert (s.ids() == mixed).all() and (s.doc_tokens() == sizes).all() and (s.doc(17) == mixed[17 * 404 : 18 * 404]).all()
    assert s.token(17, 200) == mixed[17 * 404 + 200]


def test_shard_random_access():
    r = np.random.default_rng(3)
    docs_ids = [np.r_[r.choice([5, 6, 7, 0, 9], int(n)), 0] for n in r.integers(0, 400, 60)] + [np.r_[np.full(999, 5), 0]]
    flat, sizes = np.concatenate(docs_ids), np.array([len(x) for x in docs_ids])
    for base in (1, 70_000):
        s = repair.Shard(repair.pack(flat * base, sizes))
        assert (s.ids() == flat * base).all() and (s.doc_tokens() == sizes).all() and len(s.rules) > 3
        for k, x in enumerate(docs_ids):
            assert (s.doc(k) == x * base).all() and s.token(k, len(x) // 2) == x[len(x) // 2] * base
    assert len(repair.Shard(repair.pack(np.array([0]), np.array([1]))).ids()) == 1


def test_language_id(spark, real):
    r = langid.identify(real, "text", F.col("lang"), F.col("source")).join(real.select("doc_id", F.col("lang").alias("truth")), "doc_id")
    assert r.where("lang = truth").count() / r.count() > 0.98 and r.where("kept").count() / r.count() > 0.97
    blind = langid.identify(real.withColumn("lang", F.lit(None).cast("string")), "text", None, None, model=langid.fit(real)).join(real.select("doc_id", F.col("lang").alias("truth")), "doc_id")
    assert blind.where("lang = truth").count() / blind.count() > 0.95


def test_language_priors_and_suffix_move_the_posterior(spark, real):
    m = langid.fit(real)
    rows = [(i, "le la les et une", "fr", f"a{i % 2}.site.example") for i in range(80)] + [(200 + i, "der die und das ist", "de", "c.third.example") for i in range(80)] + [(900, "xx", None, "a1.site.example"), (901, "xx", None, "b.other.example"), (902, "xx", None, "b.other.de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string")
    p = {r.doc_id: r for r in langid.identify(df, "text", F.col("lang"), F.col("host"), model=m).where("doc_id >= 900").collect()}
    assert p[900].lang == "fr" and p[902].lang == "de"


def test_language_id_on_odd_rows(spark):
    out = langid.identify(docs(spark), "text", F.col("lang"), F.col("source"))
    assert out.count() == len(ODD) and not out.where("doc_id in (2, 3, 4) and kept").count()
    assert langid.identify(docs(spark, []), "text", F.col("lang"), F.col("source")).count() == 0
    for name in ("_lang", "_kept", "keep", "told", "id", "row", "_log", "_host"):
        d = docs(spark).withColumn(name, F.lit("x"))
        kept = langid.keep_known(d)
        assert kept.columns == d.columns and {r[name] for r in kept.collect()} == {"x"}
    assert langid.keep_known(docs(spark, [])).count() == 0


def brute_languages(rows, m):
    """(lang, posterior, kept) of rows (text, declared, host), one after another in NumPy."""
    width, damp = len(m.languages), langid.DAMP
    logs, sizes, means, keys = [], [], [], []
    for t, d, h in rows:
        g = langid.trigrams((t or "").encode())
        total = m.logs[g].astype(np.float64).sum(axis=0) if len(g) else np.zeros(width)
        h = re.sub(r":\d+$", "", h or "").lower()
        suffix = h.rsplit(".", 1)[-1] if "." in h else ""
        logs.append(total / damp + langid._evidence(m, d, suffix))
        sizes.append(len(g))
        means.append(total / max(1, len(g)))
        keys.append(("", suffix, ".".join(h.split(".")[-2:]), h))
    own = [np.exp(x - x.max()) / np.exp(x - x.max()).sum() for x in logs]
    out = []
    for i in range(len(rows)):
        p = np.full(width, 1 / width)
        for level in range(4):
            n = sum((own[j] for j in range(len(rows)) if j != i and keys[j][level] == keys[i][level]), np.zeros(width))
            p = (n + langid.SMOOTHING * p) / (n.sum() + langid.SMOOTHING)
        total = logs[i] + np.log(p)
        z = np.exp(total - total.max())
        best = int(total.argmax())
        short = m.mean[best] - means[i][best]
        unlike = sizes[i] >= langid.LEAST_TRIGRAMS and short > langid.MARGIN + langid.MARGIN_ROOT / max(1, sizes[i]) ** 0.5
        out.append((m.languages[best], round(1 / z.sum(), 5), bool(1 / z.sum() >= langid.LEAST_POSTERIOR and sizes[i] > 0 and not unlike)))
    return out


def test_language_queries_equal_brute_force(spark, real):
    m = langid.fit(real)
    some = [(r.doc_id, r.text, r.lang, r.source) for r in real.orderBy("doc_id").limit(150).collect()]
    hosts = [None, "a.site.fr:80", "b.site.fr", "x.de", "plain", ""]
    some += [(10_000 + k, t, [None, "de-AT", "xx", "FR_ca"][k % 4], hosts[k % 6]) for k, (_, t, _, _) in enumerate(some[:60])] + [(20_000, None, "es", "b.site.fr"), (20_001, "", None, None), (20_002, "zzz qqq " * 40, None, None)]
    df = spark.createDataFrame(some, "doc_id long, text string, lang string, host string")
    got = {r.doc_id: (r.lang, round(r.posterior, 5), r.kept) for r in langid.identify(df, "text", F.col("lang"), F.col("host"), model=m).collect()}
    for (i, *_), want in zip(some, brute_languages([x[1:] for x in some], m)):
        assert got[i][0] == want[0] and abs(got[i][1] - want[1]) < 2e-5 and got[i][2] == want[2], (i, got[i], want)


def test_language_of_pages_query(spark):
    from tessera.llm.registry import queries

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = queries()["language_id_pages"](spark, DATA)
    assert got.count() == pages.count() and got.where("lang is not null").count() == got.count()


def brute_fp(t, n=3):
    w = SPACE.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    sh = [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] * bool(w)
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def reach(fps, radius):
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(fps, 2):
        if (a ^ b).bit_count() <= radius:
            up[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_simhash_equals_brute_force(spark, texts):
    base = LONG.split()[:400]
    near = []
    for k in range(12):
        w = list(base)
        w[k * 7] = f"q{k}"
        near.append((500 + k, " ".join(w)))
    rows = ODD + [(1000 + k, v) for k, v in list(texts.items())[:120]] + near
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    fp = {t: brute_fp(t) for _, t in rows}
    root = reach(set(fp.values()), 2)
    least = {}
    for i, t in rows:
        if i is not None:
            least[root[fp[t]]] = min(i, least.get(root[fp[t]], i))
    want = Counter((i, f"{fp[t]:016x}", least.get(root[fp[t]])) for i, t in rows)
    assert Counter(tuple(r) for r in got) == want
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("radius,crowd", [(0, 1), (1, 1), (2, 1), (2, 5), (2, 1000)])
def test_simhash_links_in_crowds_lose_nothing(spark, radius, crowd):
    r = random.Random(radius * 10 + crowd)
    fps = set()
    for _ in range(6):
        c = r.getrandbits(64)
        for _ in range(25):
            x = c
            for _ in range(r.randrange(4)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "_fp long")
    got = [(a & (2**64 - 1), b & (2**64 - 1)) for a, b in simhash.links(spark, df, radius, crowd).collect()]
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in got:
        up[find(a)] = find(b)
    want = reach(fps, radius)
    groups = lambda m: {frozenset(f for f in fps if m(f) == m(g)) for g in fps}
    assert groups(find) == groups(want.__getitem__)


def test_simhash_pivot_table_discards_pairs_and_no_link(spark):
    r, fps = random.Random(8), set()
    for _ in range(40):  # two blocks shared, the others apart: candidates of which the table discards most
        c = r.getrandbits(64)
        fps |= {c, c ^ 1 << r.randrange(64), c ^ r.getrandbits(16), c ^ r.getrandbits(16) << 40, c ^ r.getrandbits(20) << 7}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    refs = simhash.references()
    table = simhash.pivot_table(spark.createDataFrame([(signed(x),) for x in fps], "_fp long"), refs)
    got = {x["_fp"] & (2**64 - 1): list(x["_d"]) for x in table.collect()}
    assert got == {x: [(x ^ p & (2**64 - 1)).bit_count() for p in refs] for x in fps}
    pairs, many = simhash.candidates(spark, table)
    found = pairs.withColumn("gone", simhash.apart(2)).distinct().collect()
    both = [((a := x["u"] & (2**64 - 1)), (b := x["v"] & (2**64 - 1)), (a ^ b).bit_count() <= 2, x["gone"]) for x in found]
    near = {frozenset(p) for p in combinations(fps, 2) if (p[0] ^ p[1]).bit_count() <= 2}
    assert {frozenset(x[:2]) for x in both if not x[3]} >= near and not many.count()
    far = [x for x in both if not x[2]]
    assert len(far) > 40 and sum(x[3] for x in far) > 0.8 * len(far)


def test_simhash_of_one_hot_text(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 3)
    rows = [(k, "a b c d e") for k in range(9, 20)] + [(1, "a b c d e f"), (30, None), (31, "")]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    assert len(got) == 14 and {got[k] for k in range(9, 20)} == {9} and got[30] == got[31] == 30


def test_simhash_stage_keeps_one_of_each(spark):
    d = docs(spark, [(5, "a b c d"), (3, "a b c d"), (3, "a b c d"), (9, "x y z w"), (None, "a b c d"), (None, "only here now")])
    out = simhash.deduplicate(d)
    assert out.columns == d.columns
    assert sorted((r.doc_id or -1, r.text) for r in out.collect()) == [(-1, "only here now"), (3, "a b c d"), (9, "x y z w")]
    assert simhash.deduplicate(docs(spark, [])).count() == 0


MESSAGES = [("user", "</s>[INST] ok [/INST]"), ("assistant", "a\\<|end|>\n<|turn|>x<\\s>\\\\"), ("we\nird\\n<s>", ""), ("assistant", ""), ("assistant", "<|end|"), ("", "<<|turn|>>")]


def test_chat_escapes_and_spans():
    for k in range(len(MESSAGES) + 1):
        m = MESSAGES[:k]
        r = chat.Rendered(m)
        assert chat.parse(r.text) == m and not r.rewrites
        assert [chat.unescape(r.text[a:b]) for a, b in r.loss] == [t for role, t in m if role == "assistant"]
        assert not any(c in chat.escape("".join(t for _, t in m)) for c in chat.CONTROL)
        assert [b for _, b in r.turns[:-1]] == [a for a, _ in r.turns[1:]] and (not m or r.turns[-1][1] == len(r.text))
    many = MESSAGES * 40
    r = chat.Rendered(many)
    assert chat.parse(r.text) == many and len(r.turns) == len(many)


def test_chat_detects_rewriting_templates():
    counts = lambda m, o: f"{len(m)} turns\n" + chat.turns_template(m, o)
    last_only = lambda m, o: chat.turns_template(m[-1:], o)
    for t in (counts, last_only):
        assert chat.Rendered(MESSAGES[:3], t).rewrites and not chat.Rendered(MESSAGES[:3], t).loss


@pytest.mark.parametrize("n", [3, 64, 65, 200])
def test_chat_verdict_does_not_depend_on_length(n):
    many = (MESSAGES[:2] * n)[:n]
    numbered = lambda m, o: "".join(f"<{k}>{t}</{r}>" for k, (r, t) in enumerate(m)) + (f"<{len(m)}>" if o else "")
    late = lambda m, o: ("short" if len(m) > 2 else "") + numbered(m, o)
    r = chat.Rendered(many, numbered)
    assert not r.rewrites and [r.text[a:b] for a, b in r.loss] == [t for role, t in many if role == "assistant"]
    assert chat.Rendered(many, late).rewrites and not chat.Rendered(many).rewrites
    at_ten = lambda m, o: ("trimmed" if len(m) >= 10 else "") + numbered(m, o)
    assert chat.Rendered(many, at_ten).rewrites == (n >= 10)


def test_chat_query(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None), (3, 0, "assistant", "y"), (3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (None, 5, "user", "z"), (4, None, "assistant", "n"), (4, 0, "assistant", "m")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_sha256) == (2, sha("user\na\nassistant\nb\n"), sha("b"))
    assert got[2].turns_sha256 == sha("\n\n") and got[3].loss_sha256 == sha("xxy") and got[None].n_turns == 1 and got[4].loss_sha256 == sha("nm")
    assert chat.format_chats(df.limit(0)).count() == 0


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_hits(rows, items, window=10):
    win = {}
    for name, t in items:
        w = WORDS.findall(lower(t))
        if w and name is not None:
            for k in range(max(1, len(w) - window + 1)):
                win.setdefault(tuple(w[k : k + window]), set()).add(str(name))
    sizes = {len(k) for k in win}
    out = []
    for i, t in rows:
        w, hit, names = WORDS.findall(lower(t)), set(), set()
        for k in range(len(w)):
            for n in sizes:
                g = tuple(w[k : k + n])
                if len(g) == n and g in win:
                    hit.update(range(k, k + n))
                    names |= win[g]
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("most,segment,part", [(10**6, 50_000, 10**6), (10**6, 7, 10**6), (60, 50_000, 10**6), (60, 12, 2000)])
def test_decontamination_equals_brute_force(spark, texts, monkeypatch, most, segment, part):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", most)
    monkeypatch.setattr(decontaminate, "SEGMENT", segment)
    monkeypatch.setattr(decontaminate, "PART_CHARS", part)
    r = random.Random(9)
    v = "a b c d e".split()
    say = lambda n: " ".join(r.choice(v) for _ in range(n))
    items = [(i, say(r.randrange(1, 25))) for i in range(30)] + [(90, None), (91, "..."), (92, "zz"), (93, "zz"), (94, "p q r")] + [(95, "é Ü x1")]
    rows = ODD + [(1000 + i, say(r.randrange(0, 120)) + " É x1 zz, é ü x1 Zz p q-r") for i in range(40)] + [(3000 + k, t) for k, t in list(texts.items())[:30]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.report(docs(spark, rows), bench).collect()
    assert Counter(map(tuple, got)) == Counter(brute_hits(rows, items))
    assert decontaminate.report(docs(spark), bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.report(docs(spark, []), bench).count() == 0


@pytest.mark.parametrize("most", [10**6, 5])
def test_decontamination_removes_spans(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", most)
    item = "one two three four five six seven eight nine ten eleven"
    rest = " ".join(f"z{k}" for k in range(30))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, f"Before, {item.upper()}! {rest}"), (2, item), (3, rest), (4, None), (5, f"{rest} {item}")]
    d = docs(spark, rows)
    got = {r.doc_id: r for r in decontaminate.clean(d, bench).collect()}
    assert decontaminate.clean(d, bench).columns == d.columns and 2 not in got
    odd = d.withColumn("_window_spans_", F.lit(1)).withColumn("_row", F.lit(2)).withColumn("_doc", F.lit(3)).withColumn("_body", F.lit(4))
    assert decontaminate.clean(odd, bench).columns == odd.columns and decontaminate.clean(odd, bench).count() == len(got)
    assert decontaminate.clean(docs(spark, []), bench).count() == 0 and decontaminate.clean(d, bench.limit(0)).count() == len(rows)
    assert got[1].text == f"Before, ! {rest}" and got[1].n_chars == len(got[1].text) and got[3].text == rest and got[4].text is None and item not in got[5].text
