"""Headers of evidence tables; target families; alignment of levels with descriptions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import has_content, spaced_html

UP, DOWN, REFERENCES = "Upstream Key Event", "Downstream Key Event", "References"
#: Headers by what they are called after harmonization.
HEADER_NAMES = {
    UP: ("ke up", "keup", "upstream"),
    DOWN: ("ke down", "kedown", "downstream"),
    REFERENCES: ("reference", "ref", "publication", "citation"),
    "Stressor": ("stressor", "chemical", "compound", "compound class", "stressor(s)", "stressors(s)"),
    "Species": ("species", "taxa", "speies"),
    "Dose": ("dose",),
    "Study Type": ("study type",),
    "Assay": ("assay", "method"),
    "Biological Object": ("cell type",),
    "Comment": ("note", "comment", "details", "description", "notes", "comments", "summary"),
    "Route of Exposure": ("exposure route",),
}
NAME_OF = {raw: name for name, raws in HEADER_NAMES.items() for raw in raws}


def harmonized_header(header: Column) -> Column:
    """The harmonized name by the fixed list, then by the words for either side; null if neither tells."""
    low = F.trim(F.replace(F.trim(F.lower(header)), F.lit("ke:"), F.lit("")))
    listed = F.coalesce(*[F.when(low.isin(*raws), F.lit(name)) for name, raws in HEADER_NAMES.items()])
    side = F.when(F.contains(low, F.lit("ke down")) | F.contains(low, F.lit("downstream")), DOWN).when(F.contains(low, F.lit("ke up")) | F.contains(low, F.lit("upstream")), UP)
    return F.coalesce(listed, side)


def harmonizable(cells: DataFrame, key: list[str]) -> DataFrame:
    """For each key: whether its headers cover both sides and the references, and the counts of known and other headers."""
    headers = cells.select(*key, "header").distinct().withColumn("name", harmonized_header(F.col("header")))
    has = lambda n: F.coalesce(F.bool_or(F.col("name") == n), F.lit(False))
    return headers.groupBy(*key).agg((has(UP) & has(DOWN) & has(REFERENCES)).alias("harmonizable"), F.count("name").alias("known_headers"), F.count_if(F.col("name").isNull()).alias("other_headers"))


def target_family(name: Column) -> Column:
    """A target family's usual form: singular, ``R`` and ``GABA A`` written out."""
    rules = [(r"\s+", " "), (r"(Receptor|Transporter|Channel)s$", "$1"), (r"\s+R$", " Receptor"), (r"GABA\s+A\b", "GABA-A")]
    text = reduce(lambda t, r: F.regexp_replace(t, *r), rules, F.trim(name))
    return F.when(F.endswith(text, F.lit("GABA-A")) & ~F.contains(text, F.lit("Receptor")), F.concat(text, F.lit(" Receptor"))).otherwise(text)


# Alignment of an event's level with its description.

#: Levels above which a cell term is unexpected.
ABOVE_TISSUE = ("Organ", "Individual", "Population")
_COMMON = frozenset("this that with from which such than more most into their these those when where level levels event events change changes biological organization occurs occurring within".split())


def level_cues(definitions: dict[str, str]) -> dict[str, list[str]]:
    """Patterns of the words that define each level: four letters or more, quoted examples left out, plurals allowed."""
    found = {}
    for level, definition in definitions.items():
        words = dict.fromkeys(w for w in re.findall(r"[A-Za-z][A-Za-z-]{3,}", re.sub(r'"[^"]*"', " ", definition).lower()) if w not in _COMMON)
        found[level] = [rf"\b{w[:-1] if w.endswith('s') and not w.endswith(('ss', 'is', 'us')) else w}(?:s|es)?\b" for w in words]
    return found


def level_findings(events: DataFrame, definitions: dict[str, str], level: str = "level_of_biological_organization", description: str = "description", cell: str | None = None) -> DataFrame:
    """(ke_id, severity, message) rows: flags, notes and unchecked events."""
    # The text is made once a row however many cues look at it: nothing is pushed below a generator.
    events = events.withColumn("_text", F.explode(F.array(F.lower(F.coalesce(spaced_html(F.col(description)), F.lit(""))))))
    text = F.col("_text")
    found = {name: F.coalesce(*[F.when(text.rlike("(?U)" + p), F.lit(True)) for p in ps], F.lit(False)) for name, ps in level_cues(definitions).items()}
    events = events.withColumn("_cues", F.explode(F.array(F.struct(*[c.alias(n) for n, c in found.items()]))))
    cues = {name: F.col("_cues")[name] for name in found}
    own = F.coalesce(*[F.when(F.col(level) == n, c) for n, c in cues.items()], F.lit(False))
    others = F.array_compact(F.array(*[F.when(c & (F.col(level) != n), F.lit(n)) for n, c in cues.items()]))
    any_cue = reduce(lambda a, b: a | b, cues.values(), F.lit(False))
    row = lambda severity, message: F.struct(F.lit(severity).alias("severity"), message.alias("message"))
    main = (
        F.when(~has_content(F.col(level)), row("note", F.lit("no level is assigned")))
        .when(~F.col(level).isin(*definitions), row("flag", F.concat(F.lit("unknown level "), F.col(level))))
        .when(text == "", row("unchecked", F.lit("no description")))
        .when(~any_cue, row("note", F.lit("no cue words in the description")))
        .when(~own & (F.size(others) > 0), row("flag", F.concat(F.lit("cue words of other levels only: "), F.array_join(others, ", "))))
    )
    found = [main]
    if cell is not None:
        found.append(F.when(F.col(level).isin(*ABOVE_TISSUE) & F.col(cell).isNotNull(), row("note", F.concat(F.lit("cell term above tissue level: "), F.col(cell)))))
    return events.select("ke_id", F.explode(F.array_compact(F.array(*found))).alias("f")).select("ke_id", "f.*")
