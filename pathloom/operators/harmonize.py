"""Harmonization of evidence-table headers against the titles of a relationship's two events.

``cells``: ker_id, field, table_ix, row_ix, col_ix, header, value; ``kers``: ker_id,
upstream_title, downstream_title.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher
from functools import lru_cache, reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions.evidence import DOWN, REFERENCES, UP, harmonized_header

LEAST_RATIO = 0.7
#: Names of the same thing, by group.
SYNONYMS = {
    "ovarian cycle": ["disrupted ovarian cycle", "disrupted, ovarian cycle", "ovarian cycle irregularities", "irregular estrous cycles"],
    "ovarian follicle": ["follicle depletion", "follicles"],
    "reduced estrogen": ["reduced e2", "reduction plasma 17beta-estradiol", "e2 production/levels"],
    "reproductive toxicity": ["impaired fertility", "reduced fertility", "impaired spermatogenesis"],
    "testosterone": ["testosterone production/levels", "reduction testosterone", "decreased testosterone", "circulating testosterone", "intratesticular testosterone"],
    "agd": ["anogenital distance", "agd decreased"],
    "dht": ["dihydrotestosterone", "dht decrease"],
    "cryptorchidism": ["cryptorchidism", "inguinoscrotal"],
    "urethral": ["urethral tube closure", "hypospadias"],
    "aromatase": ["aromatase decrease", "aromatase activity"],
    "star": ["star protein", "star decrease"],
    "gnrh": ["gnrh", "decreased gnrh"],
    "kisspeptin": ["avpv kisspeptin", "decreased kisspeptin"],
    "gonadotropin": ["gonadotropins", "fsh", "lh"],
}
#: What is dropped or blanked before texts are compared.
_RULES = [(r"^(ke:|keup|kedown|upstream|downstream|the\s+|a\s+)", ""), (r"[,\-;:()]+", " "), (r"\s+", " ")]


def matching_form(text: Column) -> Column:
    """Lower case without a leading side word or article, punctuation as blanks."""
    out = F.trim(F.lower(text))
    for pattern, put in _RULES:
        out = F.regexp_replace(out, pattern, put)
    return F.trim(out)


def _matching_form(text: str) -> str:
    for pattern, put in _RULES:
        text = re.sub(pattern, put, text.lower().strip())
    return text.strip()


def synonym_groups(form: Column) -> Column:
    """The groups of ``SYNONYMS`` that a text in its matching form names, as bits."""
    phrases = [sorted({name, *map(_matching_form, [name, *others])}) for name, others in SYNONYMS.items()]
    named = [F.when(reduce(or_, [F.contains(form, F.lit(p)) for p in some]), F.lit(1 << at)).otherwise(F.lit(0)) for at, some in enumerate(phrases)]
    return reduce(Column.bitwiseOR, named)


def same_thing(a: Column, b: Column) -> Column:
    """Whether the groups of two texts (``synonym_groups``) have one in common."""
    return F.coalesce(a.bitwiseAND(b) != 0, F.lit(False))


@lru_cache(10_000)  # the cells of a column ask the same
def _alike(a: str, b: str) -> bool:
    """Whether the ratio of two texts is above ``LEAST_RATIO``: by lengths, then letters, then the ratio itself."""
    a, b = a.lower(), b.lower()
    if (a or b) and 2.0 * min(len(a), len(b)) / (len(a) + len(b)) <= LEAST_RATIO:
        return False  # before the texts are indexed
    m = SequenceMatcher(None, a, b)
    return m.quick_ratio() > LEAST_RATIO and m.ratio() > LEAST_RATIO


@F.arrow_udf(IntegerType())
def _likeness(text: pa.Array, up: pa.Array, down: pa.Array) -> pa.Array:
    """1 for a text like the first title, else 2 for one like the second, else 0; a null text isn't asked for."""
    asked = pc.indices_nonzero(text.is_valid())
    told = np.zeros(len(text), dtype=np.int32)
    rows = zip(*(x.take(asked).to_pylist() for x in (text, up, down)), strict=True)
    told[asked.to_numpy()] = [1 if _alike(x, u or "") else 2 if _alike(x, d or "") else 0 for x, u, d in rows]
    return pa.array(told)


def _harmonized(rows: DataFrame, kers: DataFrame) -> DataFrame:
    """Rows and ``harmonized``: by list, side words, synonyms of a title (upstream first), then likeness to one.

    One pass: the rows are read once, a title is looked through once for all of its headers, and
    only the headers that nothing else settles are compared.
    """
    header, up, down = F.col("header"), F.col("upstream_title"), F.col("downstream_title")
    titles = kers.select("ker_id", up, down, matching_form(up).alias("_u"), matching_form(down).alias("_d"))
    titles = titles.withColumns({c: synonym_groups(F.col(c)) for c in ("_u", "_d")})
    named = rows.join(titles, "ker_id", "left").withColumn("_listed", harmonized_header(header))
    named = named.withColumn("_h", F.when(F.col("_listed").isNull(), matching_form(header)))
    named = named.withColumn("_h", F.when(F.col("_listed").isNull(), synonym_groups(F.col("_h"))))
    told = F.coalesce("_listed", F.when(same_thing(F.col("_h"), F.col("_u")), UP), F.when(same_thing(F.col("_h"), F.col("_d")), DOWN))
    low = F.coalesce(F.trim(F.replace(F.trim(F.lower(header)), F.lit("ke:"), F.lit(""))), F.lit(""))
    asked = lambda x: F.when(F.col("_told").isNull(), x)
    liked = named.withColumn("_told", told).withColumn("_like", _likeness(asked(low), asked(up), asked(down)))
    return liked.select(*rows.columns, F.coalesce("_told", F.when(F.col("_like") == 1, UP).when(F.col("_like") == 2, DOWN)).alias("harmonized"))


def matched_headers(cells: DataFrame, kers: DataFrame) -> DataFrame:
    """ker_id, field, header, harmonized: each header of a field once."""
    return _harmonized(cells.select("ker_id", "field", "header").distinct(), kers)


def harmonizable_fields(headers: DataFrame) -> DataFrame:
    """ker_id, field of those whose headers name both sides and the references."""
    has = lambda n: F.coalesce(F.bool_or(F.col("harmonized") == n), F.lit(False))
    return headers.groupBy("ker_id", "field").agg((has(UP) & has(DOWN) & has(REFERENCES)).alias("ok")).filter("ok").drop("ok")


def harmonized_cells(cells: DataFrame, kers: DataFrame) -> DataFrame:
    """Cells of harmonizable fields under their harmonized headers; of two columns with one name the later (``col_ix``: the first); other headers as they are.

    Rows in which no header could be harmonized are left out.
    """
    row = ["ker_id", "field", "table_ix", "row_ix"]
    rows = _harmonized(cells.select(*row, "col_ix", "header", "value"), kers).filter("ker_id is not null and field is not null")
    of_field = Window.partitionBy("ker_id", "field")
    has = lambda n: F.coalesce(F.bool_or(F.col("harmonized") == n).over(of_field), F.lit(False))
    kept = rows.withColumn("_ok", has(UP) & has(DOWN) & has(REFERENCES)).filter("_ok and header is not null")
    known = F.bool_or(F.col("harmonized").isNotNull()).over(Window.partitionBy(*row))
    good = kept.withColumn("_known", known).filter("_known and table_ix is not null and row_ix is not null")
    return good.withColumn("name", F.coalesce("harmonized", "header")).groupBy(*row, "name").agg(F.max_by("value", "col_ix").alias("value"), F.min("col_ix").alias("col_ix"))


def harmonization_summary(headers: DataFrame) -> DataFrame:
    """Relationships, harmonizable ones, distinct headers harmonized and not."""
    ok = harmonizable_fields(headers).select("ker_id").distinct()
    rows = headers.join(ok.withColumn("ok", F.lit(True)), "ker_id", "left")
    return rows.agg(
        F.count_distinct("ker_id").alias("kers"), F.count_distinct(F.when(F.col("ok"), F.col("ker_id"))).alias("harmonizable_kers"),
        F.count_distinct(F.when(F.col("harmonized").isNotNull(), F.col("header"))).alias("harmonized_headers"), F.count_distinct(F.when(F.col("harmonized").isNull(), F.col("header"))).alias("other_headers"),
    )
