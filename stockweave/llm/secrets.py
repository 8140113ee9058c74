"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every historical version of a text is addressed by its content (SHA-256). The ledger remembers which (blob, rule, version of the rule) were
scanned and what they gave. A scan takes the blobs of the versions it is given, drops the pairs the ledger holds, looks at one
text for each blob that is left, and joins old and new findings back to all paths. A text that was committed a million times is scanned once.

Places of matches come from the pieces between them: a match starts after all pieces and matches before it. Only rows of matches
are shuffled for that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stockweave.functions.runtime import materialize
from stockweave.llm.common import text_of


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1
    base: bool = True


#: Fixed: the base kinds in their order. Runs of ``[0-9a-f]`` are matched only where they are long enough, which gives the same matches.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: A key from its BEGIN line through its END line. Where no END follows before the next five dashes: through the lines of base64, which have 16
#: characters or more but for the last; headers of an encrypted key may come first. Line ends may be written as ``\\n``. No length is bounded: all
#: loops over groups are possessive, which Java runs without recursion.
_GAP, _B64 = r"[\x20\x09-\x0D]*+(?:\\[nrt][\x20\x09-\x0D]*+)*+", "[A-Za-z0-9+/=]"
KEY_BLOCK = (r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*+(?:-{1,4}+[^-]++)*+-----END [A-Z ]*PRIVATE KEY-----"
             rf"|(?:{_GAP}(?:Proc-Type|DEK-Info|Comment):[^\r\n\\]*+)*+(?:{_GAP}{_B64}{{16,}}+)++(?:{_GAP}{_B64}++)?+|)")
RULES = BASE + (
    Rule("private_key", KEY_BLOCK, version=3, base=False),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", base=False),
)
MASK = "[secret]"


def blob_of(text) -> Column:
    return F.sha2(text_of(text), 256)


def _matches(rule: Rule, at: int, wanted: Column) -> Column:
    """Array of (kind, place of the kind, number, characters before since the last match, characters, whether it counts)."""
    whole = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
    kept = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    zipped = F.arrays_zip(whole.alias("whole"), kept.alias("kept"), F.slice(F.split("text", rule.pattern, -1), F.lit(1), F.size(whole)).alias("gap"))
    rows = F.transform(zipped, lambda x, i: F.struct(
        F.lit(rule.kind).alias("kind"), F.lit(at).alias("place"), i.alias("i"), F.length(x["gap"]).alias("gap"), F.length(x["whole"]).alias("chars"),
        (F.length(x["kept"]) >= rule.least).alias("counts")))
    return F.when(wanted & F.col("text").rlike(rule.pattern), rows)


def find(blobs: DataFrame, rules=RULES) -> DataFrame:
    """Findings (blob, kind, place, start, end) in ``blobs`` (blob, text, todo: the kinds to look for); end is exclusive, in code points."""
    each = [_matches(r, k, F.array_contains("todo", r.kind)) for k, r in enumerate(rules)]
    found = F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<struct<kind:string,place:int,i:int,gap:int,chars:int,counts:boolean>>")) for x in each]))
    rows = blobs.select("blob", F.explode(found).alias("m")).select("blob", "m.*")
    before = F.sum(F.col("gap") + F.col("chars")).over(W.partitionBy("blob", "kind").orderBy("i"))
    return (rows.withColumn("end", before.cast("bigint")).filter("counts")
            .select("blob", "kind", "place", (F.col("end") - F.col("chars")).alias("start"), "end"))


def scan(versions: DataFrame, rules=RULES, scanned: DataFrame | None = None, findings: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Scan what the ledger has not seen of ``versions`` (text; other columns are ignored).

    The ledger is two tables, None when nothing was scanned before: ``scanned`` (blob, kind, version) and ``findings`` (blob, kind,
    place, version, start, end). The return is the same two tables with the new rows only, written in the shared folder; append them to
    the ledger. A null text is the empty blob. An empty table gives two empty tables. A rule of a new version is scanned anew, and
    findings of its older versions stay in the ledger but are not joined.
    """
    texts = versions.select(blob_of("text").alias("blob"), text_of("text").alias("text"))
    known = {r.kind: r.version for r in rules}
    every = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("version")) for k, v in known.items()])
    if scanned is None:
        todo = texts.groupBy("blob").agg(F.first("text").alias("text")).withColumn("todo", F.array(*map(F.lit, known)))
        pairs = versions.select(blob_of("text").alias("blob")).distinct().select("blob", F.explode(every).alias("p")).select("blob", "p.*")
    else:
        pairs = versions.select(blob_of("text").alias("blob")).distinct().select("blob", F.explode(every).alias("p")).select("blob", "p.*")
        pairs = materialize(pairs.join(scanned, ["blob", "kind", "version"], "left_anti"), "pairs")
        wanted = pairs.groupBy("blob").agg(F.collect_set("kind").alias("todo"))  # as many as there are rules, at most
        todo = texts.join(wanted.select("blob"), "blob", "left_semi").groupBy("blob").agg(F.first("text").alias("text")).join(wanted, "blob")
    versions_of = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    new = materialize(find(todo, rules).withColumn("version", versions_of[F.col("kind")]), "findings")
    return pairs, new


def spans_by_blob(findings: DataFrame, rules=RULES) -> DataFrame:
    """One row for each blob with findings: spans, an array of (start, place, kind, end) in that order."""
    current = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.version)])
    return (findings.filter(F.col("version") == current[F.col("kind")]).groupBy("blob")
            .agg(F.sort_array(F.collect_list(F.struct("start", "place", "kind", "end"))).alias("spans")))


def report(docs: DataFrame, findings: DataFrame, rules=RULES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_<base kind>, base_sha256 and spans (``kind:start:end`` by start, then kind).

    A null or empty text has no spans. Repeated rows each get the findings of their blob.
    """
    base = [r.kind for r in rules if r.base]
    said = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind))
    of_blob = spans_by_blob(findings, rules).select(
        "blob", *[number(k).cast("bigint").alias(f"n_{k}") for k in base],
        said(F.filter("spans", lambda s: s["kind"].isin(base))).alias("_base"), said(F.col("spans")).alias("spans"))
    rows = docs.select("doc_id", blob_of("text").alias("blob")).join(of_blob, "blob", "left")
    return rows.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0).cast("bigint")).alias(f"n_{k}") for k in base],
                       F.sha2(text_of("_base"), 256).alias("base_sha256"), text_of("spans").alias("spans"))


def mask(docs: DataFrame, findings: DataFrame, rules=RULES) -> DataFrame:
    """``docs`` with every found span replaced by ``[secret]`` in the column text; overlapping spans become one. Other texts and columns stay."""
    spans = spans_by_blob(findings, rules).select(F.col("blob").alias("_blob"), F.col("spans").alias("_spans"))
    rows = docs.select(F.struct("*").alias("_row"), blob_of("text").alias("_blob")).join(spans, "_blob", "left")
    text = F.col("_row.text")

    def step(acc, s):
        """Copy up to the span and write the mask, unless the span begins inside the one before."""
        gap = F.substring(text, acc["at"] + 1, (s["start"] - acc["at"]).cast("int"))
        fresh = (s["start"] >= acc["at"]) & (s["end"] > s["start"])
        out = F.when(fresh, F.concat(acc["out"], gap, F.lit(MASK))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"].cast("int")).alias("at"), out.alias("out"))

    masked = F.aggregate("_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                         lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    new = F.when(F.col("_spans").isNull(), text).otherwise(masked)
    return rows.select(*[new.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns])
