"""Line dedup by a log-template tree. DataFrame functions only.

The tree has a fixed depth: a line goes down by its number of tokens, then by its leading tokens. Tokens that hold a
digit are fields, whatever they say. What follows the leading tokens is cut into segments; lines of a leaf that agree in
enough of them share a template in which the others are fields too. Templates that recur across documents are dropped.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Steps, read, removed, text_or_empty, written

#: Leading tokens of the tree, and segments of what follows them.
DEPTH, SEGMENTS = 3, 4
#: Different texts in which a template recurs if it is to be dropped.
DOCUMENTS = 5
#: Share of a template's tokens that are the same in all its lines.
FIXED = 0.6
# One place to start in each token, so a long token is read once.
FIELD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
SPACE = " \t\r\x0b\x0c"


def text_hash(text: str):
    """60 bits of the text's MD5: equal texts are one document here."""
    return F.conv(F.substring(F.md5(text_or_empty(text).cast("binary")), 1, 15), 16, 10).cast("long")


def tokenised(docs: DataFrame, text: str, key: str) -> DataFrame:
    """A row a line that isn't blank: key, hash of the text, place, line, masked line and its tokens."""
    rows = docs.select(text_or_empty(text).alias("_text"), F.col(key).alias("_key"), text_hash(text).alias("_h"))
    lines = rows.select("_key", "_h", F.posexplode(F.split("_text", "\n", -1)).alias("_at", "_line"))
    # Blank lines go by what is read, not by _m, which would be made twice: for the filter and for what follows.
    said = lines.filter(F.btrim("_line", F.lit(SPACE)) != "")
    bare = F.btrim("_line", F.lit(SPACE))
    # Few lines hold a digit, and looking for one costs little beside masking.
    masked = said.withColumn("_m", F.when(F.col("_line").rlike("[0-9]"), F.regexp_replace(bare, FIELD, "<*>")).otherwise(bare))
    return masked.withColumn("_t", F.split("_m", r"[\x20\x09-\x0D]+"))


def segmented(docs: DataFrame, text: str, key: str) -> DataFrame:
    """A row a line that isn't blank: key, text's hash, place, template, leaf, tokens; segments, their widths and words.

    Words are tokens that aren't fields. A line with more fields than tokens with a letter, such as a row of a table of
    numbers, is its own template, digits and all, and has no leaf.
    """
    tokens = tokenised(docs, text, key)
    n = F.size("_t")
    step = F.greatest(F.ceil((n - DEPTH) / SEGMENTS).cast("int"), F.lit(1))
    words = lambda part: F.size(F.array_remove(part, "<*>"))
    said = F.regexp_count("_m", F.lit(r"\p{L}[^\x20\x09-\x0D]*+")) >= n - words(F.col("_t"))
    rows = tokens.withColumn("_said", ~F.contains("_m", F.lit("<*>")) | said)
    parts = [F.slice("_t", F.lit(DEPTH + 1) + i * step, step) for i in range(SEGMENTS)]
    return rows.select(
        "_key", "_h", "_at", F.when(F.col("_said"), F.xxhash64("_m")).otherwise(F.xxhash64(F.btrim("_line", F.lit(SPACE)), F.lit(1))).alias("_template"),
        F.when(F.col("_said"), F.xxhash64(n, F.slice("_t", 1, DEPTH))).alias("_leaf"), n.alias("_n"), words(F.slice("_t", 1, DEPTH)).alias("_w"),
        *[c for i, p in enumerate(parts) for c in (F.xxhash64(p).alias(f"_s{i}"), F.size(p).alias(f"_n{i}"), words(p).alias(f"_w{i}"))],
    )


def generalised(lines: DataFrame, documents: int, fixed: float) -> DataFrame:
    """A row a line and generalised template (_by): its leaf and the least sets of segments that fix enough of its tokens.

    Enough is the share `fixed`, with a word after the leading tokens, and at least as many words as fields. Lines that
    agree in such a set share the template, whatever else their leaf holds.
    """
    several = (F.countDistinct("_h") >= documents) & (F.min("_template") != F.max("_template"))
    leaves = lines.filter("_leaf IS NOT NULL").groupBy("_leaf").agg(several.alias("_several")).filter("_several").select("_leaf")
    total = lambda name, part: sum((F.col(f"{name}{i}") for i in part), F.lit(0))

    def enough(part):
        same, words = F.lit(DEPTH) + total("_n", part), total("_w", part)
        full = F.least(*[F.col(f"_n{i}") for i in part]) > 0 if len(part) > 1 else F.col(f"_n{part[0]}") > 0
        return full & (same >= fixed * F.col("_n")) & (words >= 1) & (2 * (F.col("_w") + words) >= same)

    found = []
    for size in range(1, SEGMENTS):
        for part in combinations(range(SEGMENTS), size):
            least = enough(part)
            for fewer in combinations(part, size - 1) if size > 1 else ():
                least = least & ~enough(fewer)
            found.append(F.when(least, F.xxhash64("_leaf", F.lit(str(part)), *[f"_s{i}" for i in part])))
    rows = lines.join(leaves, "_leaf")
    return rows.select("_template", "_key", "_h", "_at", F.explode(F.array_compact(F.array(*found))).alias("_by"))


def repeats(rows: DataFrame, documents: int, several: bool, steps: Steps) -> DataFrame:
    """The places (_h, _at) of rows whose template _by stands in so many texts, without those in its first text."""
    groups = rows.groupBy("_by").agg(F.countDistinct("_h").alias("_docs"), F.min(F.struct("_key", "_h")).alias("_first"), F.min("_template").alias("_t0"), F.max("_template").alias("_t1"))
    groups = groups.filter((F.col("_docs") >= documents) & ((F.col("_t0") != F.col("_t1")) | F.lit(not several)))
    firsts = steps.written(groups.select("_by", F.col("_first._h").alias("_own")), "firsts")
    return rows.join(firsts, "_by").filter(F.col("_h") != F.col("_own")).select("_h", "_at")


def cleaned(docs: DataFrame, text: str = "text", key: str = "doc_id", documents: int = DOCUMENTS, fixed: float = FIXED) -> DataFrame:
    """docs with text less its recurring lines, whatever share of a document they make up, and n_lines and n_dropped (long).

    Lines end at a newline; blank lines stay and never recur. A line recurs if its template, digits aside, or a
    generalised one stands in `documents` different texts: exact copies count once. Of what recurs one occurrence stays,
    in the text of the smallest key (null first; of texts with one key, that of the smaller hash) and in exact copies of
    it, so copies never vanish. Null text stays null with 0 lines; an empty text is one blank line. Equal rows give equal
    rows. Columns n_lines and n_dropped of docs are replaced. No rows: none.
    """
    steps = Steps(docs.sparkSession, "lines")
    lines = steps.written(segmented(docs, text, key), "lines")
    exact = repeats(lines.withColumn("_by", F.col("_template")), documents, False, steps)
    general = repeats(steps.written(generalised(lines, documents, fixed), "sets"), documents, True, steps)
    gone = exact.unionByName(general).groupBy("_h").agg(F.collect_set("_at").alias("_drop"))
    drops = written(gone, "line-drops")
    removed(docs.sparkSession, steps.folder)
    # The columns of docs go as one, so that none clashes with those that the join brings.
    # Drops grow with the input: they are not broadcast where they happen to be small, so all sizes take one plan.
    rows = docs.select(F.struct("*").alias("_row"), text_hash(text).alias("_h")).join(drops.hint("merge"), "_h", "left")
    own = F.col("_row").getField
    parts = F.split(own(text), "\n", -1)
    left = F.array_join(F.filter(parts, lambda line, i: ~F.array_contains("_drop", i)), "\n")
    return rows.select(
        *[(F.when(F.col("_drop").isNull(), own(c)).otherwise(left) if c == text else own(c)).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")],
        F.when(own(text).isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_drop")).cast("long").alias("n_dropped"),
    )


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """docs with text as `cleaned` leaves it; no other column changes, whatever its name."""
    mine = [c for c in ("n_lines", "n_dropped") if c in docs.columns]
    aside = docs.withColumnsRenamed({c: f"_own_{c}" for c in mine})
    out = cleaned(aside, text, key, **options)
    return out.drop("n_lines", "n_dropped").withColumnsRenamed({f"_own_{c}": c for c in mine}).select(*docs.columns)


def op4_lines(spark, sf_dir):
    """doc_id, n_lines, n_dropped and kept_sha256 (of the text left) of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return cleaned(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(text_or_empty("text"), 256).alias("kept_sha256"))


def _sets_sql() -> str:
    """A row for each set of segments: its places (from 1), and which of the sets with one less it holds."""
    sets = [c for n in range(1, SEGMENTS) for c in combinations(range(1, SEGMENTS + 1), n)]
    return ", ".join(f"([{', '.join(map(str, c))}])" for c in sets)


OP4_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, text, string_split(coalesce(text, ''), chr(10)) AS parts,
         CAST('0x' || md5(coalesce(text, ''))[1:15] AS BIGINT) AS h
  FROM documents
),
l0 AS (SELECT r, doc_id, h, unnest(range(len(parts))) AS place, unnest(parts) AS line FROM docs),
l1 AS (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS bare FROM l0),
l2 AS (SELECT *, regexp_replace(bare, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g') AS m FROM l1 WHERE bare <> ''),
l3 AS (SELECT *, regexp_split_to_array(m, '[\x20\x09-\x0D]+') AS t FROM l2),
l4 AS (
  SELECT *, len(t) AS n, CAST(greatest(ceil((len(t) - {DEPTH}) / {SEGMENTS}.0), 1) AS BIGINT) AS step,
         len(list_filter(t, lambda x: x <> '<*>')) AS said,
         len(regexp_extract_all(m, '\\p{{L}}[^\x20\x09-\x0D]*')) AS letters
  FROM l3
),
l5 AS (
  SELECT *, list_transform(range(0, {SEGMENTS}), lambda i: t[{DEPTH} + 1 + i * step:{DEPTH} + (i + 1) * step]) AS s,
         letters >= n - said OR said = n AS is_said, len(list_filter(t[1:{DEPTH}], lambda x: x <> '<*>')) AS w
  FROM l4
),
l6 AS (
  SELECT r, doc_id, h, place, n, w, s, list_transform(s, lambda x: len(x)) AS sn, list_transform(s, lambda x: len(list_filter(x, lambda y: y <> '<*>'))) AS sw,
         CASE WHEN is_said THEN 'm' || m ELSE 'l' || bare END AS template, CASE WHEN is_said THEN concat(n, chr(10), array_to_string(t[1:{DEPTH}], chr(10))) END AS leaf
  FROM l5
),
leaves AS (SELECT leaf FROM l6 WHERE leaf IS NOT NULL GROUP BY leaf HAVING count(DISTINCT h) >= {DOCUMENTS} AND count(DISTINCT template) > 1),
sets(part) AS (VALUES {_sets_sql()}),
g0 AS (
  SELECT l.*, part, {DEPTH} + list_sum(list_transform(part, lambda i: sn[i])) AS same, list_sum(list_transform(part, lambda i: sw[i])) AS words,
         list_min(list_transform(part, lambda i: sn[i])) > 0 AS is_full
  FROM l6 l JOIN leaves USING (leaf), sets
),
g1 AS (SELECT *, is_full AND same >= CAST({FIXED} AS DOUBLE) * n AND words >= 1 AND 2 * (w + words) >= same AS is_enough FROM g0),
g2 AS (
  SELECT r, doc_id, h, place, template, concat(leaf, chr(10), CAST(part AS VARCHAR), chr(10), array_to_string(list_transform(part, lambda i: array_to_string(s[i], ' ')), chr(10))) AS by_
  FROM g1 a WHERE is_enough AND NOT EXISTS (
    SELECT 1 FROM g1 b WHERE b.r = a.r AND b.place = a.place AND b.is_enough AND len(b.part) = len(a.part) - 1 AND list_has_all(a.part, b.part)
  )
),
k AS (
  SELECT template AS by_, min({{'k': doc_id, 'h': h}}) AS first_ FROM l6 GROUP BY template HAVING count(DISTINCT h) >= {DOCUMENTS}
),
kg AS (
  SELECT by_, min({{'k': doc_id, 'h': h}}) AS first_ FROM g2 GROUP BY by_ HAVING count(DISTINCT h) >= {DOCUMENTS} AND count(DISTINCT template) > 1
),
d AS (
  SELECT l.h, l.place FROM l6 l JOIN k ON k.by_ = l.template WHERE l.h <> k.first_.h
  UNION SELECT g.h, g.place FROM g2 g JOIN kg USING (by_) WHERE g.h <> kg.first_.h
),
drops AS (SELECT h, list(place) AS gone FROM d GROUP BY h)
SELECT doc_id, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(parts) END AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_dropped,
       sha256(CASE WHEN gone IS NULL THEN coalesce(text, '')
              ELSE array_to_string(list_transform(list_filter(list_zip(parts, range(len(parts))), lambda p: NOT list_contains(gone, p[2])), lambda p: p[1]), chr(10)) END) AS kept_sha256
FROM docs LEFT JOIN drops USING (h)
"""
