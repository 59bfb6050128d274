"""Operator 10, secret scans with multipart credential linking. DataFrame functions only.

Base kinds, leftmost and not overlapping within a kind: ``assign`` (a keyword, a separator and a value of 12 or more characters), ``access``
(AKIA identifiers of 18 or more) and ``hex`` (16 or more hexadecimal digits). Spans are in code points, end exclusive.

Weak candidates aren't secrets by themselves: ``weak`` (an assignment whose value has 6 to 11 characters, one of 6 or more to a name such as
secret_access_key, private_key or pwd, or a key-like string of 32 to 64 characters that stands alone), ``ident`` (account identifiers, and AKIA
identifiers of 10 to 17) and ``endpoint`` (addresses of services). They are reported only when complementary parts
co-occur within ``scope`` code points of the same text: a weak secret with an identifier or an endpoint; an identifier
or an endpoint with a secret, weak or not, or with hex digits outside of it. The co-occurrence is an interval join on (text, bin of ``scope`` code points and its
neighbours), so a long text is never compared with itself as a whole, and a bin holds only what fits in its characters.

A position is a running sum over the lengths of the pieces between matches (``split``) and of the matches (``regexp_extract_all``), one window per text and pattern, so the work
grows with the number of matches; texts without a match skip both.

Defined results: null or empty texts have no spans; repeated rows each get a row; a null doc_id is allowed; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import cut, row_key

#: The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex", "weak", "ident", "endpoint"]
NAMED = r"""(?<![A-Za-z])(?i:(?:aws_?)?secret[_-]?(?:access[_-]?)?key|private[_-]?key|pwd|pass)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}"""
BARE = r"""(?<![A-Za-z0-9+/=_.?&%#@-])(?!AKIA)(?![0-9a-f]+(?![A-Za-z0-9+/]))(?=[A-Za-z+/]*[0-9])(?=[0-9+/]*[A-Za-z])[A-Za-z0-9+/]{32,64}={0,2}(?![A-Za-z0-9+/=_-])"""
IDENT = r"""(?i:(?<!secret)(?<!secret[_-])access_?key(?:_?id)?|client_?id|user(?:_?name|_?id)?|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,}"""
ENDPOINT = r"""(?i:https?|ftp|amqp|redis|mongodb|mysql|postgres(?:ql)?|jdbc:[a-z]+)://[^\s"'<>]+|(?i:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{3,}(?::[0-9]+)?"""
SCOPE = 200
#: Characters of one block of a text that is redacted.
BLOCK = 1024
#: The patterns by their number in the table of matches.
PATTERNS = [ASSIGN, ACCESS, HEX, NAMED, BARE, IDENT, ENDPOINT]
_FOUND = "array<struct<start:int,kind:int,stop:int>>"


def pieces(text: Column, number: int) -> Column:
    """All matches of a pattern in order: array of (pattern, gap before it, its size, size of an assigned value)."""
    pattern = PATTERNS[number]
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) if pattern == ASSIGN else F.lit(0)
    both = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda gap, m: F.struct(F.lit(number).alias("pattern"), gap.alias("gap"), F.char_length(m).alias("size"), value(m).alias("value")))
    return F.when(text.rlike(pattern), both).otherwise(F.array().cast("array<struct<pattern:int,gap:int,size:int,value:int>>"))


def _rendered(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind"] + 1), x["start"].cast("string"), x["stop"].cast("string"))))


def candidates(raw: DataFrame) -> DataFrame:
    """(row_id, start, kind, stop) of every base span and weak candidate of the rows (row_id, found)."""
    number = PATTERNS.index
    each = raw.select("row_id", F.posexplode("found").alias("pos", "m")).select("row_id", "pos", "m.*")
    stop = F.sum(F.col("gap") + F.col("size")).over(W.partitionBy("row_id", "pattern").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    placed = each.withColumn("stop", stop.cast("int")).withColumn("start", F.col("stop") - F.col("size"))
    # a key-like string counts where it is no part of another span
    others = F.when(F.col("pattern").isin(number(ASSIGN), number(NAMED), number(IDENT), number(ENDPOINT)), F.col("stop"))
    reach = F.coalesce(F.max(others).over(W.partitionBy("row_id").orderBy("start").rangeBetween(W.unboundedPreceding, 0)), F.lit(0))
    placed = placed.withColumn("reach", reach)
    is_ = lambda p: F.col("pattern") == number(p)
    kind = (
        F.when(is_(ASSIGN) & (F.col("value") >= 12), "assign").when(is_(ACCESS) & (F.col("size") >= 18), "access").when(is_(HEX), "hex")
        .when(is_(ASSIGN) & F.col("value").between(6, 11) | is_(NAMED) | is_(BARE) & (F.col("reach") < F.col("stop")), "weak").when(is_(IDENT) | is_(ACCESS) & F.col("size").between(10, 17), "ident").when(is_(ENDPOINT), "endpoint")
    )
    index = F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind) - 1
    return placed.withColumn("kind", index.cast("int")).where("kind is not null").select("row_id", "start", "kind", "stop")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Per row of ``docs``: doc_id, row_key, n_assign, n_access, n_hex, base_sha256, spans (as text), found (the same as structs), n_linked."""
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), row_key(docs[id_col], docs[text_col]).alias("row_key"), docs[id_col].cast("long").alias("doc_id"), text.alias("text"))
    raw = cut(rows.select("row_id", "row_key", "doc_id", F.concat(*[pieces(F.col("text"), k) for k in range(len(PATTERNS))]).alias("found")), "secret-matches")
    facts = cut(candidates(raw.where(F.size("found") > 0)), "secret-spans")

    number = KINDS.index
    part = facts
    ask = part.where(F.col("kind") >= number("weak")).withColumn("bin", F.floor(F.col("start") / scope))
    other = part.select("row_id", F.col("start").alias("start2"), F.col("kind").alias("kind2"), F.col("stop").alias("stop2"), F.explode(F.sequence(F.floor((F.col("start") - 1) / scope) - 1, F.floor(F.col("stop") / scope) + 1)).alias("bin"))
    # the bins of a span reach one bin beyond both of its ends; a part that starts farther on looks back over its own length
    ask = ask.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor((F.col("stop") - 1) / scope))))
    near = (F.col("start2") <= F.col("stop") + scope) & (F.col("start") <= F.col("stop2") + scope)
    near = near & ((F.col("kind2") != number("hex")) | (F.col("start2") >= F.col("stop")) | (F.col("stop2") <= F.col("start")))
    secret = [number("assign"), number("weak")]
    holder = [number("access"), number("ident"), number("endpoint")]
    complement = (F.col("kind").isin(secret) & F.col("kind2").isin(holder)) | (F.col("kind").isin(holder) & F.col("kind2").isin(*secret, number("hex")))
    linked = ask.alias("x").join(other.alias("y"), (F.col("x.row_id") == F.col("y.row_id")) & (F.col("x.bin") == F.col("y.bin")) & near & complement, "left_semi")
    linked = linked.select("row_id", "start", "kind", "stop").distinct()

    base = facts.where(F.col("kind") < number("weak"))
    held = base.union(linked).groupBy("row_id").agg(F.collect_list(F.struct("start", "kind", "stop")).alias("found"))
    out = raw.drop("found").join(held, "row_id", "left").withColumn("found", F.coalesce("found", F.array().cast(_FOUND)))
    of = lambda k: F.size(F.filter("found", lambda x: x["kind"] == number(k))).cast("long")
    strong = F.filter("found", lambda x: x["kind"] < number("weak"))
    return out.select(
        "doc_id", "row_key", *[of(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(_rendered(strong), 256).alias("base_sha256"), _rendered(F.col("found")).alias("spans"), "found", F.size(F.filter("found", lambda x: x["kind"] >= number("weak"))).cast("long").alias("n_linked"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported secret of a text replaced by ``mark``; ``chars_col`` follows the new text. Overlapping spans become one mark.

    Texts without spans pass unchanged, null texts stay null. Endpoints stay: they are reported beside secrets but hide nothing. A text with spans goes through in blocks of ``BLOCK`` characters,
    each with its own parts of the spans, so the work grows with the text and not with its square.
    """
    endpoint = KINDS.index("endpoint")
    hidden = scan(docs, id_col, text_col).select("row_key", F.filter("found", lambda x: x["kind"] != endpoint).alias("found")).where(F.size("found") > 0).dropDuplicates(["row_key"])
    hidden = cut(hidden, "secret-hidden")
    spans = hidden.select("row_key", F.explode("found").alias("x")).select("row_key", "x.start", "x.stop")
    order = W.partitionBy("row_key").orderBy("start", "stop")
    fresh = F.col("start") >= F.coalesce(F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    merged = spans.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0))).groupBy("row_key", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    cuts = merged.select("row_key", "start", "stop", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("stop") - 1) / BLOCK))).alias("block"))
    low = F.greatest(F.col("start") - F.col("block") * BLOCK, F.lit(0)).cast("int")
    high = F.least(F.col("stop") - F.col("block") * BLOCK, F.lit(BLOCK)).cast("int")
    cuts = cuts.select("row_key", "block", F.struct(low.alias("low"), high.alias("high"), (F.floor(F.col("start") / BLOCK) == F.col("block")).alias("marked")).alias("c")).groupBy("row_key", "block").agg(F.array_sort(F.collect_list("c")).alias("cuts"))

    keyed = docs.select(row_key(docs[id_col], docs[text_col]).alias("__key"), F.struct(*[docs[c] for c in docs.columns]).alias("__row"))
    texts = keyed.join(hidden.select("row_key"), F.col("__key") == F.col("row_key")).select("row_key", F.col(f"__row.`{text_col}`").alias("text")).dropDuplicates(["row_key"])
    blocks = texts.select("row_key", F.posexplode_outer(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))).alias("block", "text")).withColumn("block", F.col("block").cast("long"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, x: Column) -> Column:
        gap = F.substr(F.col("text"), state["at"] + 1, x["low"] - state["at"])
        return F.struct(x["high"].alias("at"), F.concat(state["out"], gap, F.when(x["marked"], F.lit(mark)).otherwise(F.lit(""))).alias("out"))

    clean = F.aggregate("cuts", start, step, lambda s: F.concat(s["out"], F.substr(F.col("text"), s["at"] + 1, F.lit(BLOCK))))
    new = blocks.join(cuts, ["row_key", "block"], "left").select("row_key", "block", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(clean).alias("text"))
    new = new.groupBy("row_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "").alias("__text"))
    done = keyed.join(new, F.col("__key") == F.col("row_key"), "left")
    old = lambda c: F.col(f"__row.`{c}`")
    out = {text_col: F.coalesce("__text", old(text_col)), chars_col: F.coalesce(F.char_length("__text").cast("long"), old(chars_col)) if chars_col in docs.columns else None}
    return done.select(*[out.get(c, old(c)).alias(c) for c in docs.columns])
