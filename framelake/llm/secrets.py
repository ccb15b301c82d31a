"""Secrets in texts, found by one automaton for all rules.

One pass over the bytes of all texts tells which texts can hold a secret of which
kind (a head with a byte of its tail, or a whole tail where there is no head).  Only these are read again: a backward automaton marks where matches begin,
an automaton per rule finds the longest match from there, leftmost first and
without overlap within a kind, and matches whose last part is too short go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .automata import END, Automaton, Rule, compiled

#: The three kinds that the query counts.
BASE = [
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?", "[A-Za-z0-9+/_.=-]", 8),
    Rule("access", r"AKIA", "[A-Z0-9]", 12),
    Rule("hex", r"", "[0-9a-f]", 32),
]
#: Further kinds, by the public formats of such keys.
FURTHER = [
    Rule("github", r"gh[pousr]_", "[A-Za-z0-9]", 36),
    Rule("slack", r"xox[abprs]-", "[A-Za-z0-9-]", 10),
    Rule("google", r"AIza", "[A-Za-z0-9_-]", 35),
    Rule("stripe", r"[sr]k_live_", "[A-Za-z0-9]", 16),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", "[A-Za-z0-9_-]", 8),
    Rule("private_key", r"-----BEGIN ((RSA|EC|DSA|OPENSSH|ENCRYPTED) )?PRIVATE KEY", "-", 5),
    Rule("bearer", r"(?i:bearer)\x20+", "[A-Za-z0-9._~+/=-]", 20),
]
RULES = [*BASE, *FURTHER]


class Scanner:
    """The automata of a list of rules."""

    def __init__(self, rules: list[Rule]):
        self.kinds = [r.kind for r in rules]
        # A head is rare enough to look at; only rules without one have to count their tails on the way.
        self.watch = compiled(rules, [1 if r.head else r.least for r in rules], anywhere=True, once=True)
        self.begin = compiled(rules, [1] * len(rules), anywhere=True, backward=True)
        self.whole: list[Automaton] = [compiled([r], [1], anywhere=False) for r in rules]
        self.enough: list[Automaton] = [compiled([r], [r.least], anywhere=False) for r in rules]

    def suspects(self, texts: list[bytes]) -> np.ndarray:
        """Of each text, the mask of rules that it may hold matches of; the others it does not."""
        buf = np.frombuffer(bytes([END]).join([*texts, b""]), dtype=np.uint8)
        at, mask = self.watch.hits(buf)
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
        out = np.zeros(len(texts), dtype=np.int64)
        np.bitwise_or.at(out, np.searchsorted(ends, at, side="right"), mask)
        return out

    def spans(self, text: bytes, mask: int) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes of all matches of the rules in ``mask``, by start, then rule."""
        at, masks = self.begin.hits(np.frombuffer(text, dtype=np.uint8)[::-1])
        at, masks = len(text) - 1 - at[::-1], masks[::-1]
        out = []
        for k in range(len(self.kinds)):
            if not mask >> k & 1:
                continue
            free = 0
            for start in at[masks >> k & 1 == 1].tolist():
                if start >= free:
                    free = self.whole[k].longest(text, start)
                    if self.enough[k].longest(text[start:free], 0) == free - start:
                        out.append((start, k, free))
        return sorted(out)

    def in_text(self, text: bytes, mask: int) -> list[dict]:
        """The spans with the names of their kinds, in code points."""
        buf = np.frombuffer(text, dtype=np.uint8)
        before = np.concatenate(([0], np.cumsum(buf & 0xC0 != 0x80)))
        return [{"kind": self.kinds[k], "start": int(before[a]), "end": int(before[b])} for a, k, b in self.spans(text, mask)]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The secrets of every row of ``docs`` (doc_id, text).

    Returns doc_id, spans (array of kind, start, end in code points, end
    exclusive, by start, then by the order of the rules), redacted (the text with
    each stretch that spans cover replaced by ``[secret]``; null for a null text).
    Matches of one kind do not overlap, those of unlike kinds may; both are
    listed.  A null or empty text has no spans.  Rows are independent: repeated
    rows, null ids and an empty table need no care.  A long text is scanned in
    chunks; its spans take memory of its size.  Other columns are not read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Scanner(RULES if rules is None else rules))  # some thousand transitions a rule

    def run(batches):
        scanner = shared.value
        for batch in batches:
            raw = common.raw_texts(batch.column("text"))
            found: list[list[dict]] = [[] for _ in raw]
            for i, j in common.blocks(raw):
                masks = scanner.suspects(raw[i:j])
                for k in np.flatnonzero(masks).tolist():
                    found[i + k] = scanner.in_text(raw[i + k], int(masks[k]))
            texts = batch.column("text")
            if any(found):
                texts = texts.to_pylist()
                for k, spans in enumerate(found):
                    if spans:
                        texts[k] = redacted(texts[k], spans)
                texts = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, _SPANS), texts], names=["doc_id", "spans", "redacted"])

    schema = "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>, redacted string"
    return common.arrow_map(docs.select("doc_id", "text"), run, schema)


def redacted(text: str, spans: list[dict], mark: str = "[secret]") -> str:
    """The text with a mark for each stretch that spans cover."""
    out, done, stretch = [], 0, None
    for s in [*spans, None]:
        if s is not None and stretch and s["start"] < stretch[1]:
            stretch[1] = max(stretch[1], s["end"])
            continue
        if stretch:
            out += [text[done : stretch[0]], mark]
            done = stretch[1]
        stretch = [s["start"], s["end"]] if s is not None else None
    return "".join([*out, text[done:]])


def op13_secret_scans(spark, sf_dir: str) -> DataFrame:
    """Secrets of whole ``documents``: counts and a digest of the base kinds, and all spans."""
    out = scan(common.table(spark, sf_dir, "documents"))
    listed = lambda spans: f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    count = lambda kind: F.expr(f"CAST(size(filter(spans, s -> s.kind = '{kind}')) AS BIGINT)").alias(f"n_{kind}")
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    return out.select(
        "doc_id", *[count(r.kind) for r in BASE],
        F.expr(f"sha2({listed(f'filter(spans, s -> s.kind IN ({base}))')}, 256)").alias("base_sha256"), F.expr(listed("spans")).alias("spans"),
    )
