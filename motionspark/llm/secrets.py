"""Operator 10: secrets by fixed rules and by character Markov models.

The rules find assignments to secret names, access key ids and long hexadecimal strings. Two character Markov models
(probability of a character after the one before it) are trained from the corpus with the rules as labels: one on the
values the rules found (random strings), one on all other tokens (ordinary words, numbers and identifiers). A token is a
run of ``MIN_TOKEN`` or more letters, digits and ``+/_=.-``, without marks at its end. It is a secret too if no match of a
rule overlaps it, the log-likelihood ratio of the two models summed over its characters reaches ``EVIDENCE``, and their
mean reaches ``THRESHOLD``: the shorter a token, the stronger each of its characters has to speak. There is no other
condition on its characters; what digits or letters of one case are worth is what the models learned.

Training counts pairs of characters over all documents; they are a table of fixed size at every input size.

Edge cases: a null or empty text has no spans; spans count code points, end exclusive; without any rule match there is
no model of random strings and the rules decide alone; repeated rows get the same spans; an empty table gives no rows;
other columns are ignored. A text or token of any length takes time in proportion to its length.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionspark.llm.common import small_batches

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Shortest token that the models judge.
MIN_TOKEN = 10
TOKEN = re.compile(r"[A-Za-z0-9+/_=.-]{%d,}" % MIN_TOKEN)
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
#: State before the first character of a token, and state of all other characters.
START, OTHER = len(ALPHABET), len(ALPHABET) + 1
STATES = OTHER + 1
STATE_OF = np.full(256, OTHER, np.int64)
STATE_OF[[ord(c) for c in ALPHABET]] = range(len(ALPHABET))
#: Mean log-likelihood ratio of a character from which a token is taken as random.
THRESHOLD = 0.7
#: Least sum of the log-likelihood ratios of a token's characters: one random token in about a million, log(10^6).
EVIDENCE = 14.0


def rule_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the rules' matches."""
    spans = []
    low = text.lower() if text.isascii() else text.casefold()
    if any(name in low for name in ASSIGN_NAMES):
        spans += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return spans


def values(text: str, spans) -> list[str]:
    """The random strings in the rules' matches."""
    return [ASSIGN.match(text, s)[2] if kind == "assign" else text[s:e] for s, e, kind in spans]


def others(text: str, spans) -> list[tuple[int, int]]:
    """Tokens that no rule's match overlaps, by one walk along both."""
    taken, out, k = sorted((s, e) for s, e, _ in spans), [], 0
    for m in TOKEN.finditer(text):
        s, e = m.start(), m.start() + len(m[0].rstrip("/_=.-"))
        if e - s < MIN_TOKEN:
            continue
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        j = k
        while j < len(taken) and taken[j][0] < e and taken[j][1] <= s:
            j += 1
        if j == len(taken) or taken[j][0] >= e:
            out.append((s, e))
    return out


def pair_codes(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of states of all ``tokens`` one after the other, and where each token starts."""
    sizes = np.array([len(t) for t in tokens])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    states = STATE_OF[np.frombuffer("".join(tokens).encode("latin-1", "replace"), np.uint8)]
    before = np.concatenate([[START], states[:-1]])
    before[starts] = START
    return before * STATES + states, starts


class Scores(dict):
    """Whether tokens are random: the verdicts of as many as fit are remembered, for words come again."""

    def __init__(self, table: np.ndarray, threshold: float, evidence: float, room: int = 200_000):
        super().__init__()
        self.table, self.threshold, self.evidence, self.room = table, threshold, evidence, room

    def random(self, tokens: list[str]) -> list[bool]:
        new = list({t for t in tokens if t not in self})
        own = {}
        if new:
            codes, starts = pair_codes(new)
            total = np.add.reduceat(self.table[codes], starts)
            mean = total / np.diff(np.append(starts, len(codes)))
            own = dict(zip(new, ((total >= self.evidence) & (mean >= self.threshold)).tolist(), strict=True))
            self.update(x for x in list(own.items())[: max(0, self.room - len(self))] if len(x[0]) <= 64)
        return [own[t] if t in own else self[t] for t in tokens]


def ratio_table(texts: DataFrame) -> np.ndarray | None:
    """log random - log identifier of each pair of characters, from all documents."""

    def count(batches):
        seen, held = np.zeros((2, STATES * STATES), np.int64), ([], [])

        def add(label):
            if held[label]:
                np.add(seen[label], np.bincount(pair_codes(held[label])[0], minlength=STATES * STATES), out=seen[label])
                held[label].clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                spans = rule_spans(text or "")
                for label, tokens in enumerate(([text[s:e] for s, e in others(text or "", spans)], values(text or "", spans))):
                    if tokens:
                        held[label].extend(tokens)
                        if len(held[label]) > 5000 or len(tokens[-1]) > 100_000:
                            add(label)
        add(0)
        add(1)
        at = np.nonzero(seen.sum(0))[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[0, at]), pa.array(seen[1, at])], names=["pair", "plain", "random"])

    counts = texts.mapInArrow(count, "pair long, plain long, random long").groupBy("pair").agg(F.sum("plain").alias("plain"), F.sum("random").alias("random"))
    plain, random = np.full(STATES * STATES, 0.5), np.full(STATES * STATES, 0.5)
    for r in counts.collect():  # at most one row for each pair of states
        plain[r["pair"]] += r["plain"]
        random[r["pair"]] += r["random"]
    if random.sum() == 0.5 * STATES * STATES:
        return None
    plain, random = (x.reshape(STATES, STATES) for x in (plain, random))
    return (np.log(random / random.sum(1, keepdims=True)) - np.log(plain / plain.sum(1, keepdims=True))).ravel()


def all_spans(text: str, scores: Scores | None) -> list[tuple[int, int, str]]:
    spans = rule_spans(text)
    found = []
    if scores is not None:
        tokens = others(text, spans)
        found = [(s, e, "markov") for (s, e), hit in zip(tokens, scores.random([text[s:e] for s, e in tokens]), strict=True) if hit]
    return sorted(spans + found, key=lambda x: (x[0], KINDS.index(x[2])))


def joined(spans) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in spans)


def redacted(text: str, spans) -> str:
    """``text`` with every span, or run of overlapping spans, replaced by a mark."""
    out, at = [], 0
    for s, e, _ in spans:
        if s >= at:
            out += [text[at:s], "<SECRET>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, threshold: float = THRESHOLD, evidence: float = EVIDENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans of every document."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    table = docs.sparkSession.sparkContext.broadcast(ratio_table(texts.select("text")))
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches):
        scores = None if table.value is None else Scores(table.value, threshold, evidence)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                spans = all_spans(text or "", scores)
                base = joined(x for x in spans if x[2] != "markov")
                rows.append((doc_id, *(sum(x[2] == k for x in spans) for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), joined(spans)))
            columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return texts.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string")


def redact(docs: DataFrame, threshold: float = THRESHOLD, evidence: float = EVIDENCE, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with secrets replaced by ``<SECRET>``, and ``length_col`` set to the new length where a text changed."""
    small_batches(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(ratio_table(docs.select(F.col(text_col).cast("string").alias("text"))))
    at = docs.columns.index(text_col)
    length = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches):
        scores = None if table.value is None else Scores(table.value, threshold, evidence)
        for batch in batches:
            texts, columns = batch.column(at).to_pylist(), batch.columns
            new = [t if t is None else redacted(t, all_spans(t, scores)) for t in texts]
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if length is not None:
                old = columns[length].to_pylist()
                columns[length] = pa.array([n if t == u else len(u) for n, t, u in zip(old, texts, new, strict=True)], batch.schema.field(length).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
