"""Secrets in texts: fixed patterns, and random strings that a subword vocabulary encodes badly."""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from homescore.llm.common import id_text, table

#: Kinds in the order in which spans of one start are listed; the first three are the base patterns.
KINDS = ("assign", "access", "hex", "random")
BASE = KINDS[:3]

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/=_-]{16,}")

# Known digests and identifiers, which are no secrets however random they look.
_DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.IGNORECASE)
_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.IGNORECASE)
_IDENTIFIER_PARTS = re.compile(r"[-_/+=]+")
# possessive, so that a run of letters is read in one way only, in time linear in its length
_WORD_THEN_NUMBER = re.compile(r"(?:(?:[A-Z]*+[a-z]{2,}+|[A-Z]{2,}+)++[0-9]{0,8}+|[0-9]{1,8}+)")


_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass(frozen=True)
class RandomRules:
    """A candidate is random below so many characters a token, unless it is a digest, a UUID or a name.

    A name is of words and short numbers, its words of at least so many letters a token.
    """

    most_chars_per_token: float = 1.9
    least_letters_per_token: float = 2.5


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns: leftmost, not overlapping within a kind, failing ones dropped."""
    found = []
    lower = text.lower()
    if any(name in lower for name in _NAMES):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [("hex", *m.span()) for m in _HEX.finditer(text)]


def is_known(value: str) -> bool:
    """Digests and UUIDs."""
    return bool(_DIGEST.fullmatch(value) or _UUID.fullmatch(value))


def is_name_like(value: str) -> bool:
    """Built as a name is, of runs of letters and short numbers, be the letters words or not."""
    return all(not part or _WORD_THEN_NUMBER.fullmatch(part) for part in _IDENTIFIER_PARTS.split(value))


class SecretScanner:
    def __init__(self, ranks_path: str, rules: RandomRules = RandomRules()):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.rules = rules

    def tokens(self, value: str) -> int:
        return len(self.encoding.encode_ordinary(value))

    def is_random(self, value: str) -> bool:
        if len(value) >= self.rules.most_chars_per_token * self.tokens(value) or is_known(value):
            return False
        return not is_name_like(value) or not self.has_good_words(value)

    def has_good_words(self, value: str) -> bool:
        words = _WORD.findall(value)
        return sum(map(len, words)) >= self.rules.least_letters_per_token * sum(map(self.tokens, words))

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """All spans by start, then kind. A random string inside a base span is not listed again."""
        text = text or ""
        base = sorted(base_spans(text), key=lambda x: x[1])
        starts, reach = [s for _, s, _ in base], list(accumulate((e for _, _, e in base), max))

        def inside(start: int, end: int) -> bool:  # of the base spans that begin before, one ends after
            k = bisect_right(starts, start)
            return k > 0 and reach[k - 1] >= end

        found = base + [("random", *m.span()) for m in _CANDIDATE.finditer(text) if not inside(*m.span()) and self.is_random(m[0])]
        return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


_SCANNERS: dict[tuple[str, RandomRules], SecretScanner] = {}


def _scanner(path: str, rules: RandomRules) -> SecretScanner:
    if (path, rules) not in _SCANNERS:
        _SCANNERS[path, rules] = SecretScanner(path, rules)
    return _SCANNERS[path, rules]


def scan(docs: DataFrame, ranks_path: str, rules: RandomRules = RandomRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of every row's whole text, as code points with exclusive end, and a digest of the base ones.

    A null text has none, like an empty one; an empty table gives no rows; repeated rows stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(ranks_path, rules)
        for batch in batches:
            rows = [scanner.spans(t) for t in batch.column(1).to_pylist()]
            base = [[x for x in own if x[0] in BASE] for own in rows]
            columns = [batch.column(0)]
            columns += [pa.array([sum(x[0] == kind for x in own) for own in rows], pa.int64()) for kind in KINDS]
            columns += [pa.array([hashlib.sha256(joined(own).encode()).hexdigest() for own in base], pa.string())]
            columns += [pa.array([joined(own) for own in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=_COLUMNS)

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


_COLUMNS = ["doc_id", *[f"n_{kind}" for kind in KINDS], "base_sha256", "spans"]


def redact(docs: DataFrame, ranks_path: str, rules: RandomRules = RandomRules(), mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every span of its `text` replaced by the mark; other columns and clean texts as they were.

    A column `n_chars`, if there is one, follows a text that changed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(ranks_path, rules)
        for batch in batches:
            at, counted = batch.schema.get_field_index("text"), batch.schema.get_field_index("n_chars")
            texts, changed = [], []
            for text in batch.column(at).to_pylist():
                parts, done = [], 0
                for _, start, end in scanner.spans(text):
                    if start >= done:
                        parts += [text[done:start], mark]
                    done = max(done, end)
                texts.append("".join(parts) + text[done:] if parts else text)
                changed.append(bool(parts))
            arrays = list(batch.columns)
            arrays[at] = pa.array(texts, arrays[at].type)
            if counted >= 0:
                sizes = [len(t) if c else n for t, c, n in zip(texts, changed, arrays[counted].to_pylist())]
                arrays[counted] = pa.array(sizes, arrays[counted].type)
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op4_token_efficiency_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    import public_tokenizers

    return scan(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
