"""Insights: agent runs per day and development, what is published, and checks of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.operators.upserts import pick


def latest_runs(runs: DataFrame, published: DataFrame) -> DataFrame:
    """The latest run per (day, development) on the development's canonical day, the first on which it was published.

    runs: day, development, rank, run_id, finished_at, decision; published: day, development, rank.
    """
    last = pick(runs, ["day", "development"], [F.desc("finished_at"), F.desc("run_id")])
    canon = pick(published, ["development"], [F.asc("day"), F.asc("rank")]).select("day", "development", "rank")
    return last.join(canon, ["day", "development", "rank"])


def day_summary(runs: DataFrame) -> DataFrame:
    """(day, items, decided, surfaced) over the latest run of each development."""
    last = pick(runs, ["day", "development"], [F.desc("finished_at"), F.desc("run_id")])
    return last.groupBy("day").agg(F.count("*").alias("items"), F.count("decision").alias("decided"), F.count_if(F.col("decision") == "surface").alias("surfaced"))


def result_faults(results: DataFrame) -> DataFrame:
    """(result_id, faults): headlines over 18 words, repeated connections, a surfaced result without any, a rejected one with some.

    results: result_id, headline, decision, connections (array of text).
    """
    n = F.size(F.filter(F.split(F.trim("headline"), r"\s+"), lambda w: w != ""))
    c = F.coalesce("connections", F.array().cast("array<string>"))
    codes = F.array(
        F.when(n > 18, "long_headline"),
        F.when(F.size(F.array_distinct(c)) < F.size(c), "repeated_connection"),
        F.when((F.col("decision") == "surface") & (F.size(c) == 0), "surface_without_connection"),
        F.when((F.col("decision") != "surface") & (F.size(c) > 0), "connection_without_surface"),
    )
    return results.select("result_id", F.array_compact(codes).alias("faults")).where(F.size("faults") > 0)


#: What keeps a final result from being taken, in the order in which it is looked for.
FINAL_FAULTS = ("bad_headline", "repeated_bet", "memo_not_opened", "unknown_bet", "surface_incomplete", "suppressed_incomplete", "link_in_prose")


def final_faults(results: DataFrame, opened: DataFrame, bets: DataFrame, words: int = 18) -> DataFrame:
    """(result_id, faults): results that can't be taken, with all their FINAL_FAULTS in order.

    results: result_id, headline, decision, no_match_reason, connections (array of struct with companies: array of struct with ticker and
    bet_id), and any other fields, in all of which links are looked for; result_id is a key. opened: result_id, ticker of the memos that were opened.
    bets: ticker, bet_id. A headline is one line of 1 to ``words`` words (null: none). A surfaced result has companies and
    a null reason, any other (also a null decision) has a reason and no companies. A company or bet that is null is neither opened nor known.
    """
    cited = results.select("result_id", F.explode("connections").alias("c")).select("result_id", F.explode("c.companies").alias("c")).select("result_id", "c.ticker", "c.bet_id")
    cited = cited.groupBy("result_id", "ticker", "bet_id").agg(F.count("*").alias("n"))
    read = cited.join(opened.select("result_id", "ticker", F.lit(True).alias("_read")).distinct(), ["result_id", "ticker"], "left")
    known = read.join(bets.select("ticker", "bet_id", F.lit(True).alias("_known")).distinct(), ["ticker", "bet_id"], "left")
    per = known.groupBy("result_id").agg(F.bool_or(F.col("n") > 1).alias("_twice"), F.bool_or(F.col("_read").isNull()).alias("_unread"), F.bool_or(F.col("_known").isNull()).alias("_unknown"))
    head = F.regexp_replace(F.coalesce("headline", F.lit("")), r"(?U)^\s+|\s+$", "")
    none, reason = F.col("_twice").isNull(), F.trim(F.coalesce("no_match_reason", F.lit("")))
    surfaced = F.coalesce(F.col("decision") == "surface", F.lit(False))
    said = F.lower(F.to_json(F.struct(*[c for c in results.columns if c != "result_id"])))
    met = {
        "bad_headline": (head == "") | F.contains(head, F.lit("\n")) | (F.size(F.split(head, r"(?U)\s+")) > words),
        "repeated_bet": F.col("_twice"),
        "memo_not_opened": F.col("_unread"),
        "unknown_bet": F.col("_unknown"),
        "surface_incomplete": surfaced & (none | F.col("no_match_reason").isNotNull()),
        "suppressed_incomplete": ~surfaced & (~none | (reason == "")),
        "link_in_prose": F.contains(said, F.lit("http://")) | F.contains(said, F.lit("https://")) | F.contains(said, F.lit("](")),
    }
    codes = F.array_compact(F.array(*[F.when(met[f], f) for f in FINAL_FAULTS]))
    return results.join(per, "result_id", "left").select("result_id", codes.alias("faults")).where(F.size("faults") > 0)


def merge_portfolio(audited: DataFrame, current: DataFrame, top: int = 10) -> DataFrame:
    """Audited holdings united with the current top: current weights first, audited ones where there is none.

    audited: company, weight; current: company, weight.
    """
    c = current.orderBy(F.desc("weight"), "company").limit(top).select("company", F.col("weight").alias("_c"))
    return audited.select("company", F.col("weight").alias("_a")).join(c, "company", "full_outer").select("company", F.coalesce("_c", "_a").alias("weight"), F.col("_a").isNotNull().alias("audited"), F.col("_c").isNotNull().alias("in_top"))


def relationship_counts(items: Column) -> Column:
    """struct(author_updates, quotes, retweets, related) of an array of structs with relation and own."""
    n = lambda p: F.size(F.filter(items, p)).cast("long")
    return F.struct(
        n(lambda x: x.own & (x.relation == "reply")).alias("author_updates"),
        n(lambda x: x.relation == "quote").alias("quotes"),
        n(lambda x: x.relation == "retweet").alias("retweets"),
        n(lambda x: ~x.relation.isin("quote", "retweet", "reply")).alias("related"),
    )


def needle(fields: list[Column], text: str) -> Column:
    """Whether the lower-case text stands in any of the fields, put together."""
    return F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(text.lower()))


def contiguous_ranks(ranked: DataFrame) -> DataFrame:
    """(day, first, last, n) of days whose ranks aren't 1 to n; has to be empty."""
    g = ranked.groupBy("day").agg(F.min("daily_rank").alias("first"), F.max("daily_rank").alias("last"), F.count_distinct("daily_rank").alias("n"), F.count("*").alias("_rows"))
    return g.where("first <> 1 or last <> n or n <> _rows").drop("_rows")


def violations(*checks: tuple[str, DataFrame, str], most: int = 100) -> DataFrame:
    """(code, n, examples): rows of each check's frame by code, with at most ``most`` of its keys as examples."""
    out = None
    for code, frame, key in checks:
        rows = frame.select(F.lit(code).alias("code"), F.col(key).cast("string").alias("key"))
        out = rows if out is None else out.unionByName(rows)
    w = W.partitionBy("code").orderBy("key")
    few = out.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).groupBy("code").agg(F.sort_array(F.collect_list("key")).alias("examples"))
    return out.groupBy("code").agg(F.count("*").alias("n")).join(few, "code")


def telemetry_delta(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """after - before per key; a key missing on one side counts as 0 there."""
    b = before.select(*keys, *[F.col(v).alias(f"_b_{v}") for v in values])
    j = after.select(*keys, *values).join(b, keys, "full_outer")
    return j.select(*keys, *[(F.coalesce(v, F.lit(0)) - F.coalesce(f"_b_{v}", F.lit(0))).alias(v) for v in values])


def parsed_results(runs: DataFrame) -> DataFrame:
    """(run_id, headline, decision, n_connections, companies, n_memo_calls) from results kept as JSON text; broken text gives nulls.

    runs: run_id, decision, final_json, trace_json, calls_json. companies has the name of each
    packet's company, or its ticker where it has none.
    """
    final = F.from_json("final_json", "headline string, connections array<string>")
    packets = F.from_json(F.get_json_object("trace_json", "$.memo_packets"), "map<string,struct<company:struct<name:string>>>")
    names = F.transform(F.array_sort(F.map_entries(packets)), lambda e: F.coalesce(F.nullif(e["value"]["company"]["name"], F.lit("")), e["key"]))
    calls = F.size(F.from_json("calls_json", "array<string>"))
    return runs.select("run_id", final.headline.alias("headline"), "decision", F.coalesce(F.size(final.connections), F.lit(0)).alias("n_connections"), F.coalesce(names, F.array().cast("array<string>")).alias("companies"), F.coalesce(calls, F.lit(0)).alias("n_memo_calls"))
