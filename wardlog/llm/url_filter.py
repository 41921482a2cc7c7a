"""URL filters: a bit-parallel wildcard automaton over canonical URLs.

All glob rules are packed into one multiword Shift-And mask set. A batch of URLs is run byte by byte through the automaton,
every rule and every URL of the batch at once: `D = ((D << 1) & B[byte]) | (D & S[byte])`, with B the literal masks and S
the self-loops of the wildcards. The rule set is a parameter (its size is the caller's, not the data's).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlog.llm.common import map_slices, utf8

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Wildcards of a compiled glob: any bytes, and any bytes but "/".
ANY, ANY_LABEL = -1, -2


@dataclass(frozen=True)
class UrlRule:
    """`action` for a host with all its subdomains and every path that starts with `path`."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"

    def globs(self) -> list[list[int]]:
        tail = [*utf8(self.host), *utf8(self.path), ANY]
        return [tail, [ANY_LABEL, ord("."), *tail]]


#: Rules of the registered query (fixed values).
DEFAULT_RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)


class ShiftAnd:
    """Masks of all globs side by side; `match` says for every URL of a batch which globs accept it."""

    def __init__(self, globs: Iterable[list[int]]):
        self.globs = list(globs)
        bits = sum(sum(t >= 0 for t in g) + 1 for g in self.globs)
        self.words = max(1, -(-bits // 64))
        literal = np.zeros((256, self.words), np.uint64)
        loops = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.settled = np.zeros(self.words, np.uint64)
        self.final: list[tuple[int, np.uint64]] = []
        state = 0
        for glob in self.globs:
            self.start[state >> 6] |= np.uint64(1 << (state & 63))
            loop = None
            for token in glob:
                if token >= 0:
                    state, loop = state + 1, None
                    literal[token, state >> 6] |= np.uint64(1 << (state & 63))
                else:
                    loop = token
                    chosen = np.ones(256, bool)
                    if token == ANY_LABEL:
                        chosen[ord("/")] = False
                    loops[chosen, state >> 6] |= np.uint64(1 << (state & 63))
            bit = np.uint64(1 << (state & 63))
            self.final.append((state >> 6, bit))
            if loop == ANY:
                self.settled[state >> 6] |= bit
            state += 1
        self.literal, self.loops = literal, loops

    def match(self, urls: list[bytes]) -> np.ndarray:
        """Boolean matrix [url, glob]."""
        lengths = np.array([len(u) for u in urls], np.int64)
        data = np.frombuffer(b"".join(urls), np.uint8)
        begin = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
        states = np.tile(self.start, (len(urls), 1))
        active = np.flatnonzero(lengths > 0)
        position = 0
        while active.size:
            byte = data[begin[active] + position]
            now = states[active]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            states[active] = now = (moved & self.literal[byte]) | (now & self.loops[byte])
            position += 1
            # a URL is done at its end, and as soon as only trailing wildcards are alive
            open_states = (now & ~self.settled).any(axis=1)
            active = active[(lengths[active] > position) & open_states]
        return np.stack([(states[:, w] & bit) != 0 for w, bit in self.final], axis=1) if self.final else np.zeros((len(urls), 0), bool)


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null and without `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, UPPER.lower())


def url_path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty for null and without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules: Iterable[UrlRule] = DEFAULT_RULES, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """One row per page: id, host, path, rule (null if none fits), verdict.

    The longest fitting rule wins; of equally long ones a blocking rule, then the first given. Without a fitting rule the
    verdict is `default`. Null, empty and malformed URLs have empty host and path and take the default. Repeated rows and
    null ids are kept as they are; other columns are not read. No shuffle.
    """
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.action != "block"))
    machine = ShiftAnd(g for r in ordered for g in r.globs())
    parts = pages.select(F.col(id_col).alias(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    kind = pages.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = pa.schema([(id_col, to_arrow_type(kind)), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])

    def run(piece: pa.RecordBatch) -> list:
        hosts, paths = piece.column(1).to_pylist(), piece.column(2).to_pylist()
        accepted = machine.match([utf8(h) + utf8(p) for h, p in zip(hosts, paths, strict=True)])
        fits = accepted[:, 0::2] | accepted[:, 1::2]
        first = np.where(fits.any(axis=1), fits.argmax(axis=1), -1) if ordered else np.full(len(hosts), -1)
        chosen = [ordered[k] if k >= 0 else None for k in first]
        return [piece.column(0).to_pylist(), hosts, paths, [r.name if r else None for r in chosen], [r.action if r else default for r in chosen]]

    return map_slices(parts, run, f"`{id_col}` {kind.simpleString()}, host string, path string, rule string, verdict string", arrow)
