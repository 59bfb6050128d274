"""Operator 5, benchmark decontamination by a prefix-filtered set join. DataFrame functions only.

An item's windows are its runs of ten words (all its words if it has fewer). A window is the set of its positioned shingles of five words
(of all its words if it has fewer); containment needs every one of them, so one shingle per window is a sufficient prefix.

1. *Rarity.* One pass over the documents counts the occurrences of the windows' shingles, combined before they are shuffled; nothing else leaves that pass. A window with a shingle that
   no document has can't occur.
2. *Prefix join.* A second pass joins the documents' shingles with each window's rarest one only, which gives the word at which the window must start.
3. *Length and positional bounds.* The window must start at a word of the document and end within it.
4. *Exact containment.* The document's words at that place must be the window's words.

Shingles are 64-bit hashes of words in lower case. Equal words have equal hashes, so no occurrence is lost, and step 4 compares the words themselves, so no collision is found.
The windows are broadcast where their number and bytes stay below ``broadcast_rows`` and ``broadcast_bytes``; then step 4 happens where the document is read. Beyond that both joins are shuffled, and the
surviving (document, window, start) rows are joined with their documents for step 4. A passage that many documents share costs rows in proportion to its occurrences; no group of documents is gathered.

Defined results: null, empty or word-less texts have no words and no hits; repeated documents each get a row; rows of one item_id are one item; windows of
an item without an id count as hits but name no item; no benchmark means no hits; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import cut, row_key

WINDOW = 10
SHINGLE = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: what separates words, upper case included.
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Stands first among a document's hashes and says that it was read; a shingle with this hash stands elsewhere.
MARK = 0


def words_of(text: Column) -> Column:
    """Words in their own case; positions and boundaries don't depend on case."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATOR), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_hashes(words: Column) -> Column:
    """A hash of each word in lower case; words that are equal in ASCII lower case have equal ones."""
    return F.transform(words, lambda x: F.xxhash64(F.lower(x)))


def shingle_hashes(hashes: Column, k: int) -> Column:
    """A hash of each run of ``k`` words, in order."""
    n = F.size(hashes)
    runs = F.transform(F.slice(hashes, F.lit(1), n - (k - 1)), lambda x, i: F.xxhash64(x, *[F.get(hashes, i + j) for j in range(1, k)]))
    return F.when(n >= k, runs).otherwise(F.array().cast("array<bigint>"))


def windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """item_id, window (its text), n (its words) of every window of every item."""
    items = benchmark.select(benchmark[id_col].alias("item_id"), words_of(ascii_lower(benchmark[text_col])).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    return items.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s"), F.lit(window)).alias("x")).select("item_id", F.concat_ws(" ", "x").alias("window"), F.size("x").alias("n")).distinct()


def window_shingles(distinct_windows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """window, n, k, at (0-based place), h of each window's shingles of ``k`` words."""
    w = distinct_windows.select("window", "n", F.least(F.lit(shingle), F.col("n")).alias("k"), word_hashes(F.split("window", " ")).alias("hashes"))
    parts = [w.where(F.col("k") == k).select("window", "n", "k", F.posexplode(shingle_hashes(F.col("hashes"), k)).alias("at", "h")) for k in range(1, shingle + 1)]
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.union(more)
    return whole


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE, broadcast_rows: int = 500_000, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Per row of ``docs``: doc_id, row_key, n_words, n_hit, n_items, items_sha256, contaminated."""
    listed = cut(windows(benchmark, window=window), "leak-windows")
    parts = cut(window_shingles(listed.select("window", "n").distinct(), shingle), "leak-shingles")
    n_rows, n_bytes = parts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("window")), F.lit(0))).first()
    small = n_rows <= broadcast_rows and n_bytes <= broadcast_bytes
    hint = F.broadcast if small else lambda df: df
    sizes = sorted(r[0] for r in parts.select("k").distinct().collect())  # five numbers at most

    read = docs.select(row_key(docs[id_col], docs[text_col]).alias("row_key"), docs[id_col].cast("long").alias("doc_id"), words_of(docs[text_col]).alias("w")).withColumn("hashes", word_hashes(F.col("w")))
    every = F.flatten(F.array(*[shingle_hashes(F.col("hashes"), k) for k in sizes])) if sizes else F.array().cast("array<bigint>")
    rarity = read.select(F.explode_outer(every).alias("h")).join(hint(parts.select("h").distinct()), "h", "left_semi").groupBy("h").agg(F.count("*").alias("times"))
    rarity = cut(rarity, "leak-rarity")
    ranked = parts.join(rarity, "h", "left").withColumn("times", F.coalesce("times", F.lit(0)))
    prefix = ranked.groupBy("window", "n", "k").agg(F.min("times").alias("least"), F.min(F.struct("times", "h", "at")).alias("rarest")).where("least > 0")
    prefix = cut(prefix.select("window", F.col("n").alias("n"), "k", F.col("rarest.h").alias("h"), F.col("rarest.at").alias("at")), "leak-prefix")

    # one array of longs per document goes into the join: the mark of its row, then the shingles of each size; their places follow from their index
    carried = ["row_key", "doc_id", F.size("w").alias("n_words"), *(["w"] if small else [])]
    marked = F.concat(F.array(F.lit(MARK)), *[shingle_hashes(F.col("hashes"), k) for k in sizes])
    spread = read.select(*carried, F.posexplode_outer(marked).alias("index", "found"))
    nothing = {"window": None, "n": 0, "k": 0, "h": MARK, "at": 0}
    targets = prefix.unionByName(prefix.sparkSession.range(1).select(*[F.lit(nothing[f.name]).cast(f.dataType).alias(f.name) for f in prefix.schema]))
    is_mark = F.col("index") == 0
    pos, low = F.lit(None).cast("int"), F.lit(1)
    for k in sizes:
        pos = F.when(F.col("k") == k, F.col("index") - low).otherwise(pos)
        low = low + F.greatest(F.col("n_words") - (k - 1), F.lit(0))
    start = pos - F.col("at")
    fits = (pos >= 0) & (pos <= F.col("n_words") - F.col("k"))  # the hash stands among those of the window's size
    bounds = is_mark & (F.col("k") == 0) | ~is_mark & (F.col("k") > 0) & fits & (start >= 0) & (start + F.col("n") <= F.col("n_words"))
    joined = spread.join(hint(targets), F.col("found") == F.col("h")).where(bounds)

    def equal(start: Column) -> Column:
        return ascii_lower(F.concat_ws(" ", F.slice("w", start + 1, F.col("n")))) == F.col("window")

    columns = ["row_key", "doc_id", "n_words", "window", "n", start.alias("start")]
    if small:
        hits = cut(joined.where(is_mark | equal(start)).select(*columns), "leak-hits")
        found = hits.where("window is not null")
    else:
        hits = cut(joined.select(*columns), "leak-hits")
        left = hits.where("window is not null").select("row_key", "window", "n", "start").distinct()
        found = left.join(read.select("row_key", "w").dropDuplicates(["row_key"]), "row_key").where(equal(F.col("start")))
    facts = hits.where("window is null").select("row_key", "doc_id", "n_words")
    found = cut(found.select("row_key", "window", "start", (F.col("start") + F.col("n")).alias("stop")).distinct(), "leak-found")  # repeated rows share their windows

    before = W.partitionBy("row_key").orderBy("start", "stop").rowsBetween(W.unboundedPreceding, -1)
    runs = found.select("row_key", "start", "stop").distinct().withColumn("past", F.coalesce(F.max("stop").over(before), F.lit(0)))
    hit = runs.groupBy("row_key").agg(F.sum(F.greatest(F.col("stop") - F.greatest("start", "past"), F.lit(0))).cast("long").alias("n_hit"))
    named = found.select("row_key", "window").distinct().join(listed.where("item_id is not null").select("window", F.col("item_id").cast("string").alias("item")), "window")
    named = named.groupBy("row_key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = facts.join(hit, "row_key", "left").join(named, "row_key", "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "row_key", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def sql(window: int = WINDOW) -> str:
    """DuckDB SQL of the query: windows compared as whole strings."""
    return f"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
spots AS (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - {window - 1}, 1))) AS s FROM item WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, array_to_string(w[s : s + {window - 1}], ' ') AS win, least(len(w), {window}) AS n FROM spots),
sizes AS (SELECT DISTINCT n FROM wins),
doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
places AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM doc, sizes WHERE len(w) >= n),
hit AS (SELECT a.doc_id, a.s, a.n, x.item_id FROM places a JOIN wins x ON a.n = x.n AND array_to_string(a.w[a.s : a.s + a.n - 1], ' ') = x.win),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(m.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN covered c USING (doc_id) LEFT JOIN named m USING (doc_id)"""
