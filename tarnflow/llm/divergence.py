"""Divergence audit: how far the sources of a language are from each other and from the language.

Every document becomes an exact sparse vector of term counts. A language keeps the terms that at
least MIN_DF of its documents hold, as many as there are, as a CountVectorizer with ``minDF`` and the
largest ``vocabSize`` would; but the vocabulary is a table and terms name the coordinates, so
that nothing is numbered, sorted or held in one place. Vectors are summed by source. Shares
are integers in billionths and all arithmetic is exact.

Two groups are compared over the whole vocabulary, although most coordinates are zero: with
``f(p, q)`` the divergence at one term and ``p0, q0`` the shares of a term that a group has not,

    sum over terms of f = V f(p0, q0)
        + sum over terms of the first  of f(p, q0) - f(p0, q0)
        + sum over terms of the second of f(p0, q) - f(p0, q0)
        + sum over terms of both       of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)

The middle lines need only how many terms a group has of each share; the last is
summed inside tasks over the terms that both have.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.llm.common import map_batches, materialize, table

MIN_DF = 10
TOP_TERMS = 10
#: A share of one.
UNIT = 1_000_000_000
#: Added to each count, and its double to the total for each term.
PRIOR = 2
#: Keeps letters, lower-cased, and all bytes beyond ASCII; the rest separates terms.
_LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def document_vectors(documents: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``lang, source, terms, counts`` per row: the terms of a text and how often it has each. Nulls are empty strings."""
    columns = [F.coalesce(documents[c].cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"))]
    texts = documents.select(*columns, F.coalesce(documents[text_col], F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(text.translate(_LETTERS).split()) for text in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            terms = pa.array([t for c in found for t in c], pa.binary()).cast(pa.string())
            counts = pa.array(np.fromiter((n for c in found for n in c.values()), np.int64))
            lists = [pa.ListArray.from_arrays(ends, x) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("source"), *lists], names=["lang", "source", "terms", "counts"])

    return map_batches(texts, run, "lang string, source string, terms array<string>, counts array<long>")


def group_sums(vectors: DataFrame) -> DataFrame:
    """``lang, source, term, count, df``: vectors summed by group, and how many have the term. Summed in tasks first."""
    entries = vectors.select("lang", "source", F.inline(F.arrays_zip("terms", "counts")).alias("term", "n"))
    return entries.groupBy("lang", "source", "term").agg(F.sum("n").alias("count"), F.count("*").alias("df"))


def keep_frequent(sums: DataFrame, min_df: int) -> DataFrame:
    """``lang, source, term, count, lang_count`` of the terms that enough documents of their language have.

    A term's groups meet in one row, one for each source at most.
    """
    of_term = {"held": F.collect_list(F.struct("source", "count")), "lang_df": F.sum("df"), "lang_count": F.sum("count")}
    terms = sums.groupBy("lang", "term").agg(*[f.alias(name) for name, f in of_term.items()]).where(F.col("lang_df") >= min_df)
    return terms.select("lang", F.inline("held").alias("source", "count"), "term", "lang_count").select("lang", "source", "term", "count", "lang_count")


def share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * terms))``, by long division in two steps, so that counts up to 9e13 are exact."""
    whole, top, step = total + PRIOR * terms, count + PRIOR, F.lit(100_000)
    first = _div(top * step, whole)
    rest = top * step - first * whole
    return F.lit(1) + first * F.lit(UNIT // 100_000) + _div(rest * F.lit(UNIT // 100_000), whole)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def divergence(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / (p + q))``: below 2**63 for shares."""
    return _div((p - q) * (p - q), p + q)


def group_figures(documents: DataFrame, kept: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """``lang, source, terms, total, p0, lang_total`` of every group that occurs; ``p0`` is null in a language without terms."""
    names = [F.coalesce(documents[c].cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]
    groups = documents.select(*names).distinct()
    by_group = kept.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    by_lang = kept.select("lang", "term", "lang_count").distinct().groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_count").alias("lang_total"))
    found = groups.join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left").fillna(0, ["total", "terms", "lang_total"])
    return found.withColumn("p0", F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))))


def shared_terms(entries: DataFrame) -> DataFrame:
    """``lang, source, item, value``: the last line of the sum above, for pairs of groups ``source < item`` that share terms.

    ``entries`` are ``lang, source, term, p, p0``. The groups of a term meet in one row, at most one
    entry for each source of the language. A batch of such rows adds up its pairs before they are dealt.
    """
    rows = entries.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("held")).where(F.size("held") > 1)
    narrow = rows.select("lang", F.col("held.source").alias("source"), F.col("held.p").alias("p"), F.col("held.p0").alias("p0"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("source")
            size = np.diff(lists.offsets.to_numpy())
            names = lists.flatten().dictionary_encode()
            langs = batch.column("lang").dictionary_encode()
            group = np.repeat(langs.indices.to_numpy().astype(np.int64), size) * max(1, len(names.dictionary)) + names.indices.to_numpy()
            groups, place = np.unique(group, return_inverse=True)
            p, p0 = (batch.column(c).flatten().to_numpy() for c in ("p", "p0"))
            term = np.repeat(np.arange(batch.num_rows), size)
            sums = add_pairs(place, term, p, p0, len(groups), batch.num_rows)
            low, high, value = (np.array(x, np.int64) for x in (zip(*sums) if sums else ((), (), ())))
            lang, source = np.divmod(groups, max(1, len(names.dictionary)))
            first, second = (names.dictionary.take(pa.array(source[x])) for x in (low, high))
            columns = [langs.dictionary.take(pa.array(lang[low])), first, second, pa.array(value)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "a", "b", "value"])

    summed = map_batches(narrow, run, "lang string, a string, b string, value long")
    least, most = F.least("a", "b").alias("source"), F.greatest("a", "b").alias("item")
    return summed.select("lang", least, most, "value").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def add_pairs(group: np.ndarray, term: np.ndarray, p: np.ndarray, p0: np.ndarray, groups: int, terms: int) -> list[tuple[int, int, int]]:
    """``(a, b, sum)`` for groups ``a < b`` that share terms; a group at a time against all later entries of its terms."""
    order = np.argsort(group, kind="stable")
    group, term, p, p0 = group[order], term[order], p[order], p0[order]
    begin = np.searchsorted(group, np.arange(groups + 1))
    mine = np.zeros(terms, np.int64)  # this group's share of each term, 0 where it has none
    out = []

    def f(x: np.ndarray | int, y: np.ndarray) -> np.ndarray:
        return (x - y) * (x - y) // (x + y)

    for a in range(groups - 1):
        own = slice(begin[a], begin[a + 1])
        mine[term[own]] = p[own]
        later = np.flatnonzero(mine[term[begin[a + 1] :]]) + begin[a + 1]
        mine[term[own]], x, x0 = 0, mine[term[later]], p0[begin[a]]
        if len(later):
            y, y0 = p[later], p0[later]
            value = f(x, y) - f(x, y0) - f(x0, y) + f(x0, y0)
            head = np.flatnonzero(np.concatenate([[True], np.diff(group[later]) > 0]))
            out += [(a, int(b), int(v)) for b, v in zip(group[later][head], np.add.reduceat(value, head), strict=True)]
    return out


def compare_groups(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for every ordered pair of groups of a language."""
    one = groups.select("lang", "source", "terms", "p0")
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = one.join(other, "lang").where("source <> item")
    none = F.col("terms") * F.coalesce(divergence(F.col("p0"), F.col("q0")), F.lit(0))
    # How many terms a group has of each share is all that its own terms add to a pair.
    shares = entries.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("n"))
    own = shares.join(other, "lang").where("source <> item")
    added = own.select("lang", "source", "item", (F.col("n") * (divergence(F.col("p"), F.col("q0")) - divergence(F.col("p0"), F.col("q0")))).alias("value"))
    added = added.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    turned = added.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    shared = shared_terms(entries)
    mirrored = shared.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    parts = [pairs.select("lang", "source", "item", none.alias("value")), added, turned, shared, mirrored]
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return total.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(documents: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_df: int = MIN_DF, top_terms: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every group of a language and a source.

    Part ``pair`` has every other source of the language, part ``term`` the ``top_terms`` terms that the
    group has more of than the language. Ranks go from 1 by descending value, then by item. Null
    text, lang and source are empty strings. Groups without terms are compared too; in a language without
    terms all values are 0. Rows count as often as they occur, other columns are ignored, no
    rows give no rows. What is dealt out is one number for each group, term and task; a language's term
    meets only its sources, and the result has a row for each two of them.
    """
    kept = materialize(keep_frequent(group_sums(document_vectors(documents, lang_col, source_col, text_col)), min_df), "divergence-terms")
    groups = materialize(group_figures(documents, kept, lang_col, source_col), "divergence-groups")
    shares = kept.join(groups, ["lang", "source"]).withColumn("p", share(F.col("count"), F.col("total"), F.col("terms")))
    pairs = compare_groups(shares.select("lang", "source", "term", "p", "p0"), groups)
    q = share(F.col("lang_count"), F.col("lang_total"), F.col("terms"))
    terms = shares.where(F.col("p") > q).select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), q).alias("value"))
    ordered = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = terms.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= top_terms)
    ranked = pairs.withColumn("rank", F.row_number().over(ordered))
    columns = ("lang", "source", "part", "item", "value", "rank")
    return ranked.withColumn("part", F.lit("pair")).select(*columns).unionByName(best.withColumn("part", F.lit("term")).select(*columns))


def op12(spark, sf_dir):
    """Audits all ``documents``; see :func:`audit`."""
    return audit(table(spark, sf_dir, "documents"))


#: The same audit over dense tables.
OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), counted AS (
  SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(words) AS term FROM docs) GROUP BY ALL
), vocabulary AS (
  SELECT lang, term, sum(n) AS n FROM counted GROUP BY lang, term HAVING count(*) >= 10
), size AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM vocabulary GROUP BY lang
), sums AS (
  SELECT lang, source, term, sum(n) AS n FROM counted GROUP BY ALL
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), dense AS (
  SELECT g.lang, g.source, w.term, coalesce(s.n, 0) AS n, w.n AS lang_n
  FROM groups g JOIN vocabulary w USING (lang) LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source AND s.term = w.term
), shares AS (
  SELECT d.*, (1 + (1000000000::HUGEINT * (d.n + 2)::HUGEINT) // (sum(d.n) OVER (PARTITION BY d.lang, d.source) + 2 * z.v)::HUGEINT)::BIGINT AS p,
         (1 + (1000000000::HUGEINT * (d.lang_n + 2)::HUGEINT) // (z.total + 2 * z.v)::HUGEINT)::BIGINT AS q
  FROM dense d JOIN size z USING (lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT * FROM (
    SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value,
           row_number() OVER (PARTITION BY lang, source ORDER BY ((p - q) * (p - q)) // (p + q) DESC, term) AS rank
    FROM shares WHERE n > 0 AND p > q
  ) WHERE rank <= 10
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked
"""
