"""Secret scans that link the parts of a credential.

Single patterns find what is a secret by its form (assignments, access keys, long hex runs). Short passwords and
opaque tokens are too common to report alone. They are weak candidates, and are reported only when a
complementary part, an access identifier or an endpoint, lies within ``gap`` code points in the same scope. A scope
is a document. Parts and candidates meet in an interval join: both are cut into bins of ``gap`` code points and
joined on (document, bin), so a document with very many parts is spread over its bins.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame, functions as F

from protspark.functions.lineage import cut
from protspark.llm.common import map_batches

KINDS = ["assign", "access", "hex", "linked"]
GAP = 200
MIN_ENTROPY = 3.0

_SEP = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = re.compile(rf"(?i:password|passwd|secret|token|api_?key){_SEP}([A-Za-z0-9+/_.=-]+)", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{32}")
HINT = re.compile(r"[:=]")
# Parts of a credential.
IDENTIFIER = re.compile(rf"(?<![A-Za-z0-9])(?i:user(?:name|_id)?|login|account|client_id|access_key(?:_id)?){_SEP}([A-Za-z0-9._@+-]{{3,}})", re.A)
ENDPOINT = re.compile(rf"[A-Za-z][A-Za-z0-9+.-]*://[^\x20\x09-\x0D\"'<>]+|(?<![A-Za-z0-9])(?i:host(?:name)?|endpoint|server){_SEP}([A-Za-z0-9.-]{{4,}}(?::[0-9]+)?)", re.A)
WEAK = re.compile(rf"(?<![A-Za-z0-9])(?i:pass(?:word|wd)?|pwd|pw|pin|secret|token|(?:private_|secret_|api_?)?key|auth){_SEP}([A-Za-z0-9!@#%^&*+/_.=-]{{4,}})", re.A)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
HAS_OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{20}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the single patterns, ordered."""
    out = []
    if HINT.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    at = 0
    while m := LONG_HEX.search(text, at):  # a run of 32 or more is a whole run of the pattern
        run = HEX.match(text, m.start())
        out.append((run.start(), 2, run.end()))
        at = run.end()
    return sorted(out)


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def candidate_spans(text: str, base: list[tuple[int, int, int]]) -> tuple[list, list]:
    """Weak secrets and complementary parts, both as (start, end); what a base span covers is no candidate."""
    weak, parts = [], [(s, e) for s, k, e in base if k == 1]
    has_sign = HINT.search(text) is not None
    if has_sign:
        weak += [m.span() for m in WEAK.finditer(text)]
        parts += [m.span() for m in IDENTIFIER.finditer(text)] + [m.span() for m in ENDPOINT.finditer(text)]
    if parts and HAS_OPAQUE.search(text):
        for m in OPAQUE.finditer(text):
            s = m.group()
            if any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and _entropy(s) >= MIN_ENTROPY:
                weak.append(m.span())
    taken = sorted([(s, e) for s, _, e in base] + parts)
    out, k, reach = [], 0, -1
    for s, e in sorted(set(weak)):
        while k < len(taken) and taken[k][0] < e:
            reach = max(reach, taken[k][1])
            k += 1
        if reach <= s:
            out.append((s, e))
    return out, sorted(set(parts))


def extract(docs: DataFrame) -> DataFrame:
    """Per row: base spans, their digest, and what is to be linked."""
    span = "array<struct<start: long, end: long>>"
    schema = ("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, "
              f"base array<struct<start: long, kind: int, end: long>>, weak {span}, parts {span}")

    def start():
        as_spans = lambda xs: [{"start": s, "end": e} for s, e in xs]

        def step(ids, texts):
            rows = []
            for i, text in zip(ids, texts):
                base = base_spans(text or "")
                weak, parts = candidate_spans(text or "", base)
                said = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
                kinds = Counter(k for _, k, _ in base)
                rows.append((i, kinds[0], kinds[1], kinds[2], hashlib.sha256(said.encode()).hexdigest(),
                             [{"start": s, "kind": k, "end": e} for s, k, e in base],
                             as_spans(weak if parts else []), as_spans(parts if weak else [])))
            return [list(c) for c in zip(*rows)]
        return step

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), schema, start)


def linked(found: DataFrame, gap: int = GAP) -> DataFrame:
    """(row, start, end) of weak candidates with a complementary part at most ``gap`` code points away."""
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(lo / gap), F.floor(hi / gap))).alias("bin")
    weak = found.select("row", F.explode("weak").alias("w")).select("row", "w", bins(F.col("w.start") - gap, F.col("w.end") + gap))
    parts = found.select("row", F.explode("parts").alias("p")).select("row", "p", bins(F.col("p.start"), F.col("p.end")))
    near = (F.col("p.start") <= F.col("w.end") + gap) & (F.col("p.end") >= F.col("w.start") - gap)
    # A bin holds few parts, and one that is near is enough.
    return weak.join(parts, ["row", "bin"]).where(near).select("row", "w.start", "w.end").distinct()


def scan(docs: DataFrame, gap: int = GAP) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked for every row.

    Null and empty texts have no spans: counts are 0, ``spans`` is empty and the digest is that of the empty string.
    Every row is scanned on its own, so repeated rows give repeated results.
    """
    found = cut(extract(docs)).withColumn("row", F.monotonically_increasing_id())
    more = linked(found, gap).groupBy("row").agg(F.collect_set(F.struct("start", F.lit(3).alias("kind"), "end")).alias("more"))
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start: bigint, kind: int, end: bigint>>"))))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    said = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return found.join(more, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(said, ",").alias("spans"),
        F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_linked"))
