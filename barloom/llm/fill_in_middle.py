"""Fill-in-middle: each text is cut at two places of its id's hash, and the parts change places behind sentinels.

All of it is Spark SQL. regexp_extract_all makes a text's units twice over: windows of WINDOW code points each, and the
code points of those windows in which a cut lies, so that a long text costs two short arrays besides one string for
each window. conv and substring of sha2 give the cuts, slice and array_join the parts, and restoring splits at the sentinels.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import table

#: Code points of a window.
WINDOW = 1024


@dataclass(frozen=True)
class Arrangement:
    """Sentinels before prefix, suffix and middle; the share of texts that are rearranged and, of these, of suffix-first ones, in percent."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    rearranged: int = 90
    suffix_first: int = 20
    salt: str = "1:"

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        overlap = any(b.startswith(a[k:]) for a in marks for b in marks for k in range(1, len(a)))
        if not all(marks) or overlap or any(a in b for a, b in permutations(marks, 2)):
            raise ValueError("sentinels must not be empty, nor overlap one another: texts could not be restored")


STANDARD = Arrangement()


def _units(text: Column, size: int) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}" if size > 1 else "(?s)."), F.lit(0))


def _joined(units: Column, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(units, start, length), "")


def _draw(digest: str, k: int) -> Column:
    """The k-th (from 1) eight digits of a hex digest as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def rearrange(docs: DataFrame, how: Arrangement = STANDARD) -> DataFrame:
    """doc_id, n (code points), form (plain, psm or spm), prefix_chars and middle_chars (null if plain), output of each row.

    A null text is an empty one, which is plain, as are texts with a sentinel in them. A null doc_id is hashed as an
    empty one; repeated rows come back each; other columns are ignored.
    """
    marked = F.col("text").contains(how.prefix) | F.col("text").contains(how.suffix) | F.col("text").contains(how.middle)
    d = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.sha2(F.concat(F.lit(how.salt), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256))
    d = d.withColumns({"windows": _units(F.col("text"), WINDOW), "n": F.char_length("text").cast("long")})
    one, other = _draw("digest", 1) % (F.col("n") + 1), _draw("digest", 2) % (F.col("n") + 1)
    plain = (F.col("n") == 0) | marked | (_draw("digest", 3) % 100 >= how.rearranged)
    d = d.withColumns({"a": F.least(one, other), "b": F.greatest(one, other), "form": F.when(plain, "plain").when(_draw("digest", 4) % 100 < how.suffix_first, "spm").otherwise("psm")})

    place = {c: ((F.floor(F.col(c) / WINDOW)).cast("int"), (F.col(c) % WINDOW).cast("int")) for c in "ab"}
    d = d.withColumns({f"units_{c}": F.coalesce(_units(F.get("windows", place[c][0]), 1), F.array().cast("array<string>")) for c in "ab"})
    (window_a, at_a), (window_b, at_b) = place["a"], place["b"]
    windows, units_a, units_b = F.col("windows"), F.col("units_a"), F.col("units_b")
    prefix = F.concat(_joined(windows, 1, window_a), _joined(units_a, 1, at_a))
    inside = _joined(units_a, at_a + 1, F.greatest(at_b - at_a, F.lit(0)))
    across = F.concat(_joined(units_a, at_a + 1, WINDOW), _joined(windows, window_a + 2, F.greatest(window_b - window_a - 1, F.lit(0))), _joined(units_b, 1, at_b))
    suffix = F.concat(_joined(units_b, at_b + 1, WINDOW), _joined(windows, window_b + 2, F.size(windows)))
    d = d.withColumns({"prefix": prefix, "middle": F.when(window_a == window_b, inside).otherwise(across), "suffix": suffix})
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(how.prefix), "prefix", F.lit(how.suffix), "suffix", F.lit(how.middle), "middle"))
        .when(F.col("form") == "spm", F.concat(F.lit(how.suffix), "suffix", F.lit(how.prefix), "prefix", F.lit(how.middle), "middle"))
        .otherwise(F.col("text"))
    )
    moved = F.col("form") != "plain"
    return d.select("doc_id", "n", "form", F.when(moved, F.col("a")).alias("prefix_chars"), F.when(moved, F.col("b") - F.col("a")).alias("middle_chars"), output.alias("output"))


def restore(rearranged: DataFrame, how: Arrangement = STANDARD) -> DataFrame:
    """`rearranged` (with its output and form) and a column `restored`: the text that the output was made of."""
    sentinels = "|".join(re.sub(r"(\W)", r"\\\1", m) for m in (how.prefix, how.suffix, how.middle))
    form, parts = F.col("form"), F.col("_parts")
    d = rearranged.withColumn("_parts", F.split("output", sentinels, -1))
    text = F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(F.col("output"))
    return d.withColumn("restored", text).drop("_parts")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text of `documents` rearranged and restored; nulls and repeated rows as `rearrange` has them."""
    d = restore(rearrange(table(spark, sf_dir, "documents")))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return d.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output").alias("output_sha256"), sha("restored").alias("restored_sha256"))


OP13_SQL = """
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
  SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS y,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS keep, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS turn FROM hashed
), cut AS (
  SELECT doc_id, t, n, substr(t, 1, least(x, y)) AS p, substr(t, least(x, y) + 1, greatest(x, y) - least(x, y)) AS m, substr(t, greatest(x, y) + 1) AS s, least(x, y) AS a, greatest(x, y) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR keep >= 90 THEN 'plain' WHEN turn < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn
)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM cut
"""
