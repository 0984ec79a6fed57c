"""Rules of a research round that need no model: gaps, retries, budgets, statements and their verification."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.evidence import answer_status, verdict_action
from granary.operators.store import kept


def gap_counts(gaps: DataFrame, key: str) -> DataFrame:
    """(key, open, closed, others): gaps by status."""
    s = F.col("status")
    return gaps.groupBy(key).agg(F.count_if(s == "open").alias("open"), F.count_if(s == "closed").alias("closed"), F.count_if(~F.coalesce(s, F.lit("")).isin("open", "closed")).alias("others"))


def targets_open(targets: Column, open_gaps: Column) -> Column:
    """Whether any of a query's gaps is open; true if none is open at all."""
    return (F.size(open_gaps) == 0) | F.coalesce(F.arrays_overlap(targets, open_gaps), F.lit(False))


def gaps_after(reported: DataFrame, prior: DataFrame, claims: DataFrame, rounds: DataFrame, key: str) -> DataFrame:
    """(key, gap_id, description, status): a round's gaps.

    Reported ones take the place of those before; with none reported the former stay; where there
    are neither gaps nor claims, one gap is made up: the evidence as such is missing.
    """
    cols = [key, "gap_id", "description", "status"]
    has = reported.select(key).distinct()
    stay = prior.join(has, key, "left_anti")
    none = rounds.select(key).distinct().join(has, key, "left_anti").join(prior.select(key).distinct(), key, "left_anti").join(claims.select(key).distinct(), key, "left_anti")
    made = none.select(key, F.lit("gap_001").alias("gap_id"), F.lit("Country-specific evidence is missing").alias("description"), F.lit("open").alias("status"))
    return reported.select(*cols).unionByName(stay.select(*cols)).unionByName(made)


def facts(reported: DataFrame, claims: DataFrame, key: str) -> DataFrame:
    """(key, facts): what a round reports as established, or else each claim as 'id: quotation' in order."""
    own = reported.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "fact"))).alias("_f")).select(key, F.transform("_f", lambda x: x["fact"]).alias("facts"))
    text = F.concat_ws(": ", "claim_id", "quoted_text")
    other = claims.groupBy(key).agg(F.array_sort(F.collect_list(text)).alias("facts")).join(own.select(key), key, "left_anti")
    return own.unionByName(other)


def extract_again(candidates: Column, accepted: Column, retries: Column, most: Column) -> Column:
    """Whether claims are extracted once more: there were candidates, all were rejected, and retries are left."""
    return (candidates > 0) & (accepted == 0) & (retries < most)


def query_count_message(n: Column, least: int, most: int) -> Column:
    """What is wrong with a number of queries, or null."""
    few = F.concat(F.lit("Got "), n.cast("string"), F.when(n == 1, " query").otherwise(" queries"), F.lit(f"; need at least {least}."))
    many = F.concat(F.lit("Got "), n.cast("string"), F.lit(f" queries; need at most {most}."))
    return F.when(n < least, few).when(n > most, many)


def first_of_batch(rows: DataFrame, batch: str, pos: str, most: int) -> DataFrame:
    """The first ``most`` rows of each batch."""
    w = Window.partitionBy(batch).orderBy(pos)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def web_queries(queries: DataFrame, batch: str, pos: str, most: int) -> DataFrame:
    """The queries that go to the web: of each batch the first whose destination is web or both, as many as ``most`` allows."""
    return first_of_batch(queries.where(F.col("destination").isin("web", "both")), batch, pos, most)


def supported(statements: DataFrame, claims: DataFrame) -> DataFrame:
    """(statement_id, text, claim_ids, ...) with only claims that there are, in their order, repeats kept; statements left without any go."""
    each = statements.select("statement_id", F.posexplode("claim_ids").alias("_i", "claim_id")).join(claims.select("claim_id").distinct(), "claim_id", "left_semi")
    ids = each.groupBy("statement_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "claim_id"))), lambda x: x["claim_id"]).alias("claim_ids"))
    return statements.drop("claim_ids").join(ids, "statement_id")


def claims_for(statements: DataFrame, claims: DataFrame) -> DataFrame:
    """(statement_id, claim_id, quoted_text): the claims a statement is verified against, once each."""
    each = statements.select("statement_id", F.explode(F.array_distinct("claim_ids")).alias("claim_id"))
    return each.join(claims.select("claim_id", "quoted_text"), "claim_id").select("statement_id", "claim_id", "quoted_text")


def after_verdict(statements: DataFrame, most: int) -> DataFrame:
    """(statement_id, text, verdict, attempt, removed, repaired) -> (statement_id, text, attempt, action): one step of verification.

    keep and drop end it; repair goes on with the repaired text, unless that was removed or is
    blank, which drops the statement.
    """
    action = verdict_action(F.col("verdict"), F.col("attempt"), F.lit(most))
    fixed = F.trim(F.coalesce("repaired", F.lit("")))
    gone = F.coalesce("removed", F.lit(False)) | (fixed == "")
    out = F.when((action == "repair") & gone, "drop").otherwise(action)
    return statements.select("statement_id", F.when(out == "repair", fixed).otherwise(F.col("text")).alias("text"), F.when(out == "repair", F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"), out.alias("action"))


def verified(statements: DataFrame, judge: Callable[[DataFrame], DataFrame], most: int) -> tuple[DataFrame, int]:
    """(statement_id, text) through rounds of verification -> those that are kept, as they then read, and the number of rounds.

    ``judge`` takes all statements that are still open (statement_id, text, attempt) at once and gives
    each a verdict: (statement_id, verdict, removed, repaired).  What is repaired goes on to the next
    round, after ``most`` repairs a partly entailed statement is kept and another one dropped, so there
    are at most ``most`` + 1 rounds.  Open statements lie in the shared folder between rounds.
    """
    open_, kept_, rounds = kept(statements.select("statement_id", "text", F.lit(0).alias("attempt")), "open"), [], 0
    while not open_.isEmpty():
        rounds += 1
        told = open_.join(judge(open_).select("statement_id", "verdict", "removed", "repaired"), "statement_id")
        step = kept(after_verdict(told, most), "verdicts")
        kept_.append(step.where("action = 'keep'").select("statement_id", "text", "attempt"))
        open_ = step.where("action = 'repair'").select("statement_id", "text", "attempt")
    out = kept_[0] if kept_ else open_
    for k in kept_[1:]:
        out = out.union(k)
    return out, rounds


def report_rows(statements: DataFrame, claims: DataFrame, sources: DataFrame, gaps: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A report's own rows: claims (key, claim_id, source_id, ...) that its statements cite, the sources of those once each, and gaps that aren't closed."""
    cited = statements.select(key, F.explode("claim_ids").alias("claim_id")).distinct()
    held = claims.join(cited, "claim_id")
    used = sources.join(held.select(key, "source_id").distinct(), "source_id")
    return held, used, gaps.where(F.coalesce("status", F.lit("")) != "closed")


def final_report(statements: DataFrame, claims: DataFrame, sources: DataFrame, gaps: DataFrame, key: str) -> DataFrame:
    """(key, status, statements, claims, sources, open_gaps): a report's status anew from its statements, what they cite, and the gaps that aren't closed."""
    status = answer_status(statements, key, "text")
    cited = statements.select(key, F.explode("claim_ids").alias("claim_id")).distinct().join(claims.select("claim_id", "source_id"), "claim_id")
    used = cited.join(sources.select("source_id"), "source_id", "left_semi").groupBy(key).agg(F.countDistinct("claim_id").alias("claims"), F.countDistinct("source_id").alias("sources"))
    n = statements.groupBy(key).agg(F.count("text").alias("statements"))
    open_ = gaps.where(F.coalesce("status", F.lit("")) != "closed").groupBy(key).agg(F.count("*").alias("open_gaps"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return status.join(n, key).join(used, key, "left").join(open_, key, "left").select(key, "status", "statements", zero("claims"), zero("sources"), zero("open_gaps"))
