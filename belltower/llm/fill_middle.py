"""Fill-in-the-middle transformation by lookaround splitting.

A unit grammar lists pairs of neighbouring character classes between which one unit ends and
the next begins. It becomes a regular expression of zero width that looks at the class before
and the class after a place, so that Spark's split takes nothing away: the pieces, joined,
are the text. Two places drawn from a hash of the id cut the pieces into prefix, middle and
suffix, which are put in order between markers (psm: prefix, suffix, middle; spm: suffix,
prefix, middle) or left plain. Everything is a column expression: no shuffle, no state.

Cases: a null text counts as empty; an empty text, which split would give one empty piece,
has no pieces and is plain; a text that holds a marker is plain, so that every output can be
taken apart again; a null id draws as an empty one; rows that share an id draw the same
numbers; an empty table gives an empty result; columns of clashing names stay beside the new
ones, which get longer names. One text's pieces are held in memory at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from belltower.llm.common import fresh

#: Pairs of classes (the character before, the character after) between which units meet.
GRAMMARS: dict[str, tuple[tuple[str, str], ...]] = {
    "chars": ((".", "."),),
    "words": ((r"\s", r"\S"),),
    "lines": ((r"\n", "."),),
    "sentences": ((r"[.!?]", r"\s"),),
    "scripts": ((r"\p{L}", r"\P{L}"), (r"\P{L}", r"\p{L}"), (r"\p{N}", r"\P{N}"), (r"\P{N}", r"\p{N}")),
}
MARKERS = ("<P>", "<S>", "<M>")
SEED, PLAIN_FROM, SPM_BELOW = 1, 90, 20
#: A literal beyond the basic plane, in an alternative that never holds, makes Java look back by code points instead of by UTF-16 units; a dot needs none.
BY_CODE_POINTS = "|(?!)\U0010ffff"


def boundary(grammar: tuple[tuple[str, str], ...]) -> str:
    """The zero-width regular expression of a unit grammar."""
    found = "(?s)" + "|".join(f"(?<={before})(?={after})" for before, after in grammar)
    return found if all(before == "." for before, _ in grammar) else found + BY_CODE_POINTS


def units(text: Column, grammar: tuple[tuple[str, str], ...]) -> Column:
    """The pieces of a text, which joined are the text; of an empty one none."""
    return F.when(F.octet_length(text) > 0, F.split(text, boundary(grammar), -1)).otherwise(F.array().cast("array<string>"))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def draw(digits: Column, k: int) -> Column:
    """The k-th (from 0) number below 2**32 of a hash's hex digits."""
    return F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long")


def run_of(pieces: Column, first: Column, count: Column) -> Column:
    return F.array_join(F.slice(pieces, (first + 1).cast("int"), count.cast("int")), "")


def transformed(docs: DataFrame, units_by: str = "chars", seed: int = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """docs and, under fresh names, the columns n (units), form, prefix, middle, suffix (null if plain) and output.

    plain_from: of a hundred draws, those from here on stay plain; spm_below: of the others, those below are spm.
    """
    names = docs.columns
    text, p, h, a, b, n, form, prefix, middle, suffix, output = (fresh(names, x) for x in ("__whole", "__pieces", "__hash", "__first", "__second", "n", "form", "prefix", "middle", "suffix", "output"))
    # what later steps read more than once is a column of its own, computed once
    rows = docs.select("*", F.coalesce("text", F.lit("")).alias(text), digest(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias(h))
    kind = F.when((F.octet_length(text) == 0) | F.col(text).rlike("|".join(MARKERS)) | (draw(F.col(h), 2) % 100 >= plain_from), "plain").when(draw(F.col(h), 3) % 100 < spm_below, "spm").otherwise("psm")
    rows = rows.select("*", units(F.col(text), GRAMMARS[units_by]).alias(p), kind.alias(form))
    rows = rows.withColumn(n, F.size(p).cast("long"))
    rows = rows.select(*names, text, p, form, n, (draw(F.col(h), 0) % (F.col(n) + 1)).alias(a), (draw(F.col(h), 1) % (F.col(n) + 1)).alias(b))
    rows = rows.select(*names, text, p, form, n, F.least(a, b).alias(a), F.greatest(a, b).alias(b))
    cut = F.col(form) != "plain"
    rows = rows.select(
        *names, text, n, form,
        F.when(cut, run_of(F.col(p), F.lit(0), F.col(a))).alias(prefix),
        F.when(cut, run_of(F.col(p), F.col(a), F.col(b) - F.col(a))).alias(middle),
        F.when(cut, run_of(F.col(p), F.col(b), F.col(n) - F.col(b))).alias(suffix),
    )
    at, then, last = (F.lit(m) for m in MARKERS)
    psm, spm = F.concat(at, prefix, then, suffix, last, middle), F.concat(then, suffix, at, prefix, last, middle)
    return rows.select(*names, n, form, prefix, middle, suffix, F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(text)).alias(output))


def restored(rows: DataFrame, output: str, form: str, name: str) -> DataFrame:
    """rows and, as `name`, the text rebuilt from output and form alone."""
    names = rows.columns
    parts = fresh(names, "__parts")
    # no marker occurs in a part, nor across its ends, so that the order of the markers tells the parts; split once, in a column of its own
    rows = rows.withColumn(parts, F.when(F.col(form) != "plain", F.split(output, "|".join(MARKERS), -1)))
    p = F.col(parts)
    psm, spm = F.concat(p[1], p[3], p[2]), F.concat(p[2], p[3], p[1])
    return rows.select(*names, F.when(F.col(form) == "plain", F.col(output)).when(F.col(form) == "psm", psm).otherwise(spm).alias(name))


def query(docs: DataFrame) -> DataFrame:
    made = transformed(docs.select("doc_id", "text"))
    sizes = made.select("doc_id", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"), "output")
    return restored(sizes, "output", "form", "text").select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(F.col("text")).alias("restored_sha256"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a) ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM c"""
