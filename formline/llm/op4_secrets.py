"""Secret scans with multipart credential linking, with DataFrame functions only.

Strong spans are secrets by their own form. Weak candidates (an identifier, a short or bare secret value, an endpoint) prove
nothing alone: an interval join within each text looks for complementary parts whose gap to the candidate is at most `scope`
code points, and only candidates with such parts are reported. The join is an equi-join on (text, bin of `scope` code points):
a part lies in the bins it covers, a candidate looks into the bins its scope covers, so the pairs a candidate makes are
bounded by the parts that fit into a few bins, whatever the length of the text or the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.llm.common import documents, materialize

# The forms of the strong spans.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # the runs AKIA[A-Z0-9]+ of 16 characters or more
HEX = r"[0-9a-f]{32,}"  # the runs [0-9a-f]+ of 32 characters or more

# Weak forms. A value that the strong form has matched but found too short is weak as well.
WEAK_ID = r"""(?i:access_?key_?id|client_?id|user_?name|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,}|\bAKIA[A-Z0-9]{4,11}(?![A-Z0-9])"""
WEAK_KEY = r"""(?<![0-9A-Za-z+/_.=-])[0-9a-f]{16,31}(?![0-9A-Za-z+/_=-])"""
ENDPOINT = r"""(?i:https?|s3|ftp|jdbc:[a-z]+)://[A-Za-z0-9._~%:/?&=@+-]+"""

#: Kinds in the order in which they are listed, with the part of a credential that each is.
KINDS = {"assign": "key", "access": "id", "hex": "key", "weak_id": "id", "weak_key": "key", "endpoint": "endpoint"}
_ORDER = list(KINDS)
SCOPE = 160
#: Rows with spans that are broadcast at most, and a quarter of their spans; beyond, texts meet them by a shuffled join.
BROADCAST_ROWS = 200_000
#: Matches whose positions are added up one by one.
_CHUNK = 256
_SPAN = "array<struct<start:int,end:int,kind:int>>"


def _spans(text: Column, pattern: str, kind: str, least: int = 0, most: int = 1 << 30, group: int = 0) -> Column:
    """Spans of the pattern's leftmost non-overlapping matches whose group has least to most code points.

    Positions are sums over the matches before; they are taken in chunks, as an array that grows by one is copied each time.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    empty = F.array().cast(_SPAN)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["found"])
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(_ORDER.index(kind)).alias("kind"))
        out = F.when(F.length(x["value"]).between(least, most), F.array_append(acc["out"], span)).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    def spans(matches: Column, at: Column) -> Column:
        return F.aggregate(matches, F.struct(at.alias("at"), empty.alias("out")), step, lambda acc: acc["out"])

    def before(acc: Column, chunk: Column) -> Column:
        length = F.aggregate(chunk, F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.length(x["found"]))
        return F.struct((acc["at"] + length).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))

    matches = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("found"), value.alias("value"))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / _CHUNK).cast("int")), lambda i: F.slice(matches, i * _CHUNK + 1, F.lit(_CHUNK)))
    starts = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), before, lambda acc: acc["out"])
    many = F.flatten(F.zip_with(chunks, starts, spans))
    return F.when(~text.rlike(pattern), empty).when(F.size(found) <= _CHUNK, spans(matches, F.lit(0))).otherwise(many)


def render(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined, by start and then by the order of kinds."""
    in_order = F.array_sort(spans, lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["kind"] - y["kind"]))
    name = lambda k: F.element_at(F.array(*map(F.lit, _ORDER)), k + 1)
    return F.array_join(F.transform(in_order, lambda x: F.concat(name(x["kind"]), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")


def parts(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, base (strong spans) and weak (candidates) of every row of docs; the text itself is not kept."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(_spans(text, ASSIGN, "assign", 8, group=2), _spans(text, ACCESS, "access"), _spans(text, HEX, "hex"))
    weak = F.concat(_spans(text, WEAK_ID, "weak_id"), _spans(text, ASSIGN, "weak_key", 1, 7, group=2), _spans(text, WEAK_KEY, "weak_key"), _spans(text, ENDPOINT, "endpoint"))
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), base.alias("base"), weak.alias("weak"))


def link(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, text_hash and linked, the candidates of parts() that complementary parts confirm; rows without any are left out.

    An identifier needs a key or an endpoint, a key an identifier or an endpoint, an endpoint both an identifier and a key.
    A candidate that overlaps a strong span is part of what is reported already and is dropped; overlapping parts do not
    confirm each other. Rows that are equal in doc_id and text share one result.
    """
    role = lambda k: F.element_at(F.array(*map(F.lit, KINDS.values())), k + 1)
    some = found.where(F.size("weak") > 0).select("doc_id", "text_hash", "base", "weak").dropDuplicates(["doc_id", "text_hash"])
    key = ["doc_id", "text_hash"]
    cand = some.select(*key, F.explode("weak").alias("c")).distinct()
    cand = cand.select(*key, "c", F.explode(F.sequence(F.expr(f"greatest(c.start - {scope}, 0) div {scope}"), F.expr(f"(c.end + {scope}) div {scope}"))).alias("bin"))
    part = some.select(*key, F.explode(F.concat("base", "weak")).alias("p"))
    part = part.select(*key, "p", F.explode(F.sequence(F.expr(f"p.start div {scope}"), F.expr(f"p.end div {scope}"))).alias("bin"))
    a, b = cand.alias("a"), part.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash")) & (F.col("a.bin") == F.col("b.bin"))
    near = (F.col("p.start") <= F.col("c.end") + scope) & (F.col("c.start") <= F.col("p.end") + scope)
    apart = (F.col("p.start") >= F.col("c.end")) | (F.col("c.start") >= F.col("p.end"))
    strong = F.col("p.kind") < F.lit(_ORDER.index("weak_id"))
    has = lambda what: F.max(apart & (role(F.col("p.kind")) == what))
    seen = a.join(b, same & near).groupBy(F.col("a.doc_id").alias("doc_id"), F.col("a.text_hash").alias("text_hash"), "c")
    seen = seen.agg(has("id").alias("id"), has("key").alias("key"), has("endpoint").alias("endpoint"), F.max(~apart & strong).alias("inside"))
    mine = role(F.col("c.kind"))
    told = F.when(mine == "id", F.col("key") | F.col("endpoint")).when(mine == "key", F.col("id") | F.col("endpoint")).otherwise(F.col("id") & F.col("key"))
    return seen.where(told & ~F.col("inside")).groupBy(*key).agg(F.collect_list("c").alias("linked"))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, text_hash, base and all spans (arrays of start, end, kind) for every row of docs, in code points, end exclusive.

    Nulls: a null text is empty and has no spans; a null doc_id is a value like others. Repeated rows each get their row.
    An empty table gives an empty result; columns of docs beside doc_id and text are not read.
    """
    found = materialize(parts(docs), "op4-parts")
    linked = link(found, scope).withColumnsRenamed({"doc_id": "_doc_id", "text_hash": "_text_hash"})
    out = found.join(linked, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_hash") == F.col("_text_hash")), "left")
    return out.select("doc_id", "text_hash", "base", F.concat("base", F.coalesce("linked", F.array().cast(_SPAN))).alias("spans"))


def redact(docs: DataFrame, scope: int = SCOPE, mark: str = "[SECRET]") -> DataFrame:
    """docs with every reported span of the text replaced by mark; overlapping spans become one mark. Rows without spans stay as they are.

    n_chars, if there is such a column, follows the text; other columns stay, whatever their names. Nulls, repeated rows and empty tables: as in scan().
    """
    found = materialize(scan(docs, scope).where(F.size("spans") > 0).select("doc_id", "text_hash", F.array_sort("spans").alias("spans")).dropDuplicates(["doc_id", "text_hash"]), "op4-spans")
    n_rows, n_spans = found.agg(F.count("*"), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("own"))
    few = n_rows <= BROADCAST_ROWS and n_spans <= 4 * BROADCAST_ROWS
    rows = rows.join(F.broadcast(found) if few else found, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("text_hash")), "left")
    old = F.col("row.text")

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        between = F.substring(old, acc["at"] + 1, x["start"] - acc["at"])
        out = F.when(fresh, F.concat(acc["out"], F.array(between))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate("spans", start, step, lambda acc: F.concat(F.array_join(acc["out"], mark), F.lit(mark), F.substring(old, acc["at"] + 1, F.length(old))))
    rows = rows.withColumn("clean", F.when(F.col("spans").isNotNull(), clean))
    changes = {"text": F.coalesce("clean", old)}
    if "n_chars" in docs.columns:
        changes["n_chars"] = F.when(F.col("clean").isNotNull(), F.length("clean")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[changes.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, see scan(): doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    out = scan(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == _ORDER.index(kind))).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(render(F.col("base")), 256).alias("base_sha256"), render(F.col("spans")).alias("spans"))

