"""Operator 7: URL filter by a bit-parallel wildcard automaton.

All rules are globs over the canonical URL (host, then path and query, without scheme and fragment). They are packed into
the bits of a few 64-bit words, one bit for each position of each glob, and simulated together: one shift, one AND with
the mask of the next character and one AND with the self-loops of ``*`` move every rule forward by a character. NumPy
does this for all URLs of a batch at once.

In a glob ``*`` stands for any characters, or in front of the first ``/`` for any but ``/``; everything else stands for
itself. Rules of the form ``host/path`` also fit all subdomains. The longest rule that fits decides; then the globs, in
which a block wins over an allow; a URL that nothing fits is allowed.

Edge cases: a null URL or one without ``://`` has an empty host and path and fits no rule; characters are UTF-8 bytes;
very long URLs take as many steps as they have bytes; repeated rows are judged alike; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionspark.llm.common import small_batches

SITE_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
GLOB_RULES = (
    ("block", "*spam-farm*/*"), ("block", "*casino*/*"), ("block", "*/*/wp-login*"), ("block", "*/*.exe"), ("block", "*/*sessionid=*"), ("allow", "*.gov/*"),
)


class Automaton:
    """Shift-And over several words for ``globs``; ``run(texts)`` tells which globs each text fits as a whole."""

    def __init__(self, globs: list[str]):
        follow, loop, starts, ends = [], [], [], []
        for glob in globs:
            starts.append(len(follow))
            follow.append(None)  # a start position is entered at the beginning only
            loop.append(None)
            in_host = True
            for c in glob.encode():
                if c == ord("*"):
                    loop[-1] = "host" if in_host else "any"
                else:
                    in_host &= c != ord("/")
                    follow.append(c)
                    loop.append(None)
            ends.append(len(follow) - 1)
        self.words = (len(follow) + 63) // 64 or 1
        self.step = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        for at, (c, star) in enumerate(zip(follow, loop, strict=True)):
            word, bit = at // 64, np.uint64(1 << at % 64)
            if c is not None:
                self.step[c, word] |= bit
            if star:
                self.stay[:, word] |= bit
                if star == "host":
                    self.stay[ord("/"), word] &= ~bit
        self.first = self.bits(starts)
        self.ends = ends

    def bits(self, places) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for at in places:
            out[at // 64] |= np.uint64(1 << at % 64)
        return out

    def run(self, texts: list[str]) -> np.ndarray:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        order = np.argsort([-len(r) for r in raw], kind="stable")
        lengths = np.array([len(raw[i]) for i in order])
        flat = np.frombuffer(b"".join(raw[i] for i in order), np.uint8)
        begins = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(raw) else np.zeros(0, int)
        state = np.repeat(self.first[None, :], len(raw), 0)
        live = len(raw)
        for at in range(int(lengths[0]) if len(raw) else 0):
            while live and lengths[live - 1] <= at:
                live -= 1
            c = flat[begins[:live] + at]
            now = state[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = moved & self.step[c] | now & self.stay[c]
        hit = np.stack([state[:, e // 64] >> np.uint64(e % 64) & np.uint64(1) for e in self.ends], 1).astype(bool)
        out = np.empty_like(hit)
        out[order] = hit
        return out


def url_parts(url: str | None) -> tuple[str, str, str]:
    """Host, path and canonical form (host, path and query) of a URL."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", "", ""
    rest = rest.split("#", 1)[0]
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path, _, query = rest[cut:].partition("?")
    return host, path, host + path + ("?" + query if query else "")


def judge(urls, automaton: Automaton, site_rules, glob_rules):
    parts = [url_parts(u) for u in urls]
    hits = automaton.run([h + p for h, p, _ in parts]) if parts else np.zeros((0, 0), bool)
    free = automaton.run([c for _, _, c in parts]) if parts else hits
    n = len(site_rules)
    lengths = np.array([len(r) for _, r in site_rules])
    for k, (host, path, _) in enumerate(parts):
        fits = hits[k, :n] | hits[k, n : 2 * n]
        if host and fits.any():
            best = int(np.where(fits, lengths, -1).argmax())
            yield host, path, site_rules[best][1], site_rules[best][0]
            continue
        verdicts = {v for (v, _), hit in zip(glob_rules, free[k, 2 * n :], strict=True) if hit}
        yield host, path, None, "block" if "block" in verdicts else "allow"


def filter_urls(pages: DataFrame, site_rules=SITE_RULES, glob_rules=GLOB_RULES, url_col: str = "url") -> DataFrame:
    """``pages`` with a column ``judged``: struct of host, path, rule and verdict."""
    small_batches(pages.sparkSession)
    globs = [f"{rule}*" for _, rule in site_rules] + [f"*.{rule}*" for _, rule in site_rules] + [g for _, g in glob_rules]

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def judged(urls: pd.Series) -> pd.DataFrame:
        automaton = Automaton(globs)
        return pd.DataFrame(list(judge(urls, automaton, site_rules, glob_rules)), columns=["host", "path", "rule", "verdict"])

    return pages.withColumn("judged", judged(F.col(url_col).cast("string")))
