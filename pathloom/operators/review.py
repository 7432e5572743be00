"""Review of events by an outside judge: the judge is passed in, its verdicts become findings."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import spaced_html

#: Longest description the judge sees; longer ones are cut, and their findings say so.
DESCRIPTION_LIMIT = 12_000


#: Fixed value: what a judge says that can't tell.
CANNOT_TELL = "cannot tell"
VERDICT = "ke_id string, text_digest string, definitions_digest string, level string, fits boolean, best_fit_level string, several boolean, reasoning string, error string, description_truncated boolean"
Judge = Callable[[], Callable[[str, str, str], dict]]


def definitions_digest(definitions: dict[str, str]) -> str:
    """Twelve digits that tell the definitions a review was made against from later ones."""
    return hashlib.sha256(json.dumps(definitions, sort_keys=True).encode()).hexdigest()[:12]


def instructions(definitions: dict[str, str]) -> str:
    """What a judge is told: the levels' definitions are the only measure; without any there is nothing to judge by."""
    told = [f"{level}: {text}" for level, text in definitions.items() if text]
    if not told:
        raise ValueError("no level has a definition")
    rules = [
        "You read descriptions of events and say whether each fits the level it is assigned to.",
        "Judge by the definitions below alone. The level is where a change happens, not where it is measured; an event has one level.",
        f"Where a description does not say what changes, answer {CANNOT_TELL!r} as its best fit; do not guess from the title.",
    ]
    return "\n\n".join([*rules, *told])


def question(ke_id: str, title: str | None, level: str | None, description: str) -> str:
    """One event as put to a judge."""
    return f"Event {ke_id}: {(title or '').strip()}\nAssigned level: {level or '(none)'}\n\n{description}"


def asked_events(events: DataFrame, definitions: dict[str, str], level: str = "level_of_biological_organization", description_limit: int | None = DESCRIPTION_LIMIT) -> DataFrame:
    """Events as asked about: ke_id, level, text (cut at the limit, if there is one), description_truncated, and digests of text with level and of the definitions."""
    text = F.coalesce(spaced_html(F.col("description")), F.lit(""))
    cut = F.length(text) > description_limit if description_limit else F.lit(False)
    text = F.when(cut, F.rtrim(F.substring(text, 1, description_limit))).otherwise(text) if description_limit else text
    rows = events.select(F.col("ke_id").cast("string").alias("ke_id"), F.col(level).alias("level"), text.alias("text"), cut.alias("description_truncated"))
    return rows.withColumns({"text_digest": F.sha2(F.concat_ws("\n", F.coalesce("level", F.lit("")), "text"), 256), "definitions_digest": F.lit(definitions_digest(definitions))})


def verdicts(asked: DataFrame, judge: Judge) -> DataFrame:
    """A judge's verdicts on events as asked; its failures are kept as ``error``.  ``judge()`` makes one function for each partition."""
    names = [part.split()[0] for part in VERDICT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = judge()
        for batch in batches:
            found = []
            for ke_id, level, text, cut, text_digest, digest in batch[["ke_id", "level", "text", "description_truncated", "text_digest", "definitions_digest"]].itertuples(index=False):
                said, error = {}, None
                try:
                    said = ask(ke_id, level, text)
                except Exception as failure:  # the judge is foreign code: its failure is a finding, not the job's
                    error = f"{type(failure).__name__}: {failure}"
                found.append((ke_id, text_digest, digest, level, bool(said.get("assigned_level_fits")), said.get("best_fit_level"), bool(said.get("spans_multiple_levels")), said.get("reasoning"), error, cut))
            yield pd.DataFrame(found, columns=names)

    return asked.filter("text <> '' and level is not null and level <> ''").mapInPandas(run, VERDICT)


def findings(asked: DataFrame, said: DataFrame) -> DataFrame:
    """What is worth reading: disagreements, descriptions that don't tell or span levels, failures, and events with nothing to ask about.

    ke_id, severity, message, best_fit_level, description_truncated; nothing where the judge agrees.
    """
    best = F.coalesce("best_fit_level", F.lit(CANNOT_TELL))
    unsure = F.lower(F.trim(best)) == CANNOT_TELL
    severity = F.when(F.col("error").isNotNull(), "error").when(~F.col("fits"), F.when(unsure, "note").otherwise("flag")).when(F.col("several"), "flag")
    level = F.col("level")
    message = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(~F.col("fits") & unsure, F.concat(F.lit("the description does not tell whether "), level, F.lit(" fits")))
        .when(~F.col("fits"), F.concat(F.lit("the description reads as "), best, F.lit(", not "), level))
        .otherwise(F.concat(level, F.lit(" fits, but the description spans several levels")))
    )
    told = said.select("ke_id", severity.alias("severity"), message.alias("message"), F.when((severity == "flag"), F.coalesce("best_fit_level", F.lit(CANNOT_TELL))).alias("best_fit_level"), "description_truncated").filter("severity is not null")
    bare = asked.filter("text = '' or level is null or level = ''")
    unchecked = bare.select("ke_id", F.lit("unchecked").alias("severity"), F.when(F.col("text") == "", "no description").otherwise("no level is assigned").alias("message"), F.lit(None).cast("string").alias("best_fit_level"), "description_truncated")
    return told.unionByName(unchecked)


def reviewed_events(events: DataFrame, judge: Judge, level: str = "level_of_biological_organization", description_limit: int | None = DESCRIPTION_LIMIT) -> DataFrame:
    """Findings of a judge on every event, asked anew."""
    asked = asked_events(events, {}, level, description_limit)
    return findings(asked, verdicts(asked, judge))


def resumed_review(events: DataFrame, judge: Judge, definitions: dict[str, str], path: str, level: str = "level_of_biological_organization", description_limit: int | None = DESCRIPTION_LIMIT) -> DataFrame:
    """Findings of a judge on every event; verdicts are kept as a table at ``path`` and only what it lacks is asked.

    A verdict holds for an event's text, level and the definitions; a change of any of them, or a
    failure, makes the event be asked again.  New verdicts are added by one write, so a run that
    breaks adds none and the next one goes on from what is there.
    """
    spark = events.sparkSession
    asked = asked_events(events, definitions, level, description_limit)
    key = ["ke_id", "text_digest", "definitions_digest"]
    empty = spark.createDataFrame([], VERDICT)
    empty.write.mode("append").parquet(path)  # the table is there from the first run on
    known = spark.read.schema(empty.schema).parquet(path).filter("error is null")
    verdicts(asked.join(known, key, "left_anti"), judge).write.mode("append").parquet(path)
    said = spark.read.schema(empty.schema).parquet(path).join(asked.select(*key).distinct(), key, "left_semi")
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("error").isNotNull()))
    return findings(asked, said.withColumn("_n", rank).filter("_n = 1").drop("_n"))


def severity_summary(findings: DataFrame) -> DataFrame:
    """Number of findings of each severity, one column each."""
    return findings.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("flag", "note", "unchecked", "error")])


def check_summary(findings: DataFrame) -> DataFrame:
    """Findings of each check by severity."""
    return findings.groupBy("check").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("flag", "note", "unchecked", "error")])
