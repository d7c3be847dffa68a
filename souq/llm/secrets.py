"""Secret scans by one combined deterministic automaton (operator 13).

All rules are compiled into one minimal automaton (``automaton.py``).  A task
runs it over the bytes of a batch of texts in a single pass; where it accepts,
a rule's match ends.  The match's start comes from the same rule's automaton of
reversed strings, run backwards from that end over the match alone.

Scale: texts are scanned where they lie, batch by batch; nothing is shuffled,
and what the tasks receive is the automaton (about two thousand states).
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .automaton import Automaton, backwards, parse
from .common import small_batches, table
from .textops import slices, to_batch


class Rule(NamedTuple):
    """A kind of secret.

    ``scan`` tells where matches are: leftmost first, as long as possible,
    not overlapping.  It ends in a run (``x+`` or ``x{n,}``), so a match ends where the run does.
    ``keep``: a match counts only if it fits this expression as a whole.
    """
    kind: str
    scan: str
    keep: str
    any_case: bool = False


# ---------------------------------------------------------------------------
# Patterns of the secrets.
# ---------------------------------------------------------------------------
_ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]"""
BASE_RULES = (
    Rule("assign", _ASSIGN + "+", _ASSIGN + "{6,}", any_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{16,}"),
    # the match of a run of hexadecimal digits is the run: the shortest need not be looked at
    Rule("hex", r"[0-9a-f]{8,}", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]+", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("stripe", r"[rs]k_(live|test)_[A-Za-z0-9]+", r"[rs]k_(live|test)_[A-Za-z0-9]{16,}"),
    Rule("private", r"-----BEGIN\x20([A-Z]+\x20)*PRIVATE\x20KEY-{5,}", r"-----BEGIN\x20([A-Z]+\x20)*PRIVATE\x20KEY-{5,}"),
)
RULES = BASE_RULES + MORE_RULES


class Scanner:
    """The compiled rules; travels to the tasks."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.forward = Automaton([parse(r.scan, r.any_case) for r in rules], search=True)
        back = [Automaton([backwards(parse(r.scan, r.any_case)), backwards(parse(r.keep, r.any_case))], search=False) for r in rules]
        # one list of next states by byte for each state: a match's bytes are walked one by one
        self.back = [([b.moves[s][b.classes].tolist() for s in range(len(b.moves))], b.accepts.tolist(), b.dead) for b in back]

    def match(self, rule: int, text: bytes, begin: int, end: int) -> tuple[int, bool] | None:
        """The leftmost start from ``begin`` on of a match that ends at ``end``, and whether it is kept."""
        moves, accepts, dead = self.back[rule]
        state, found = 0, None
        for i in range(end - 1, begin - 1, -1):
            state = moves[state][text[i]]
            if state == dead:
                break
            if accepts[state] & 1:
                found = i, bool(accepts[state] & 2)
        return found

    def spans(self, data: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, rule, end) of all kept matches in the bytes of some texts, ordered by start and rule.

        ``first`` has every text's offset and the end of the last one.
        """
        state = self.forward.run(data, first[:-1])
        hit = self.forward.accepts[state]
        after = np.append(hit[1:], 0)
        after[first[1:][first[1:] > 0] - 1] = 0  # a text's end ends its matches
        ended = hit & ~after
        at = np.flatnonzero(ended)
        if not len(at):
            return []
        text_of = first[np.searchsorted(first, at, "right") - 1]
        raw, out = data.tobytes(), []
        free = [0] * len(self.rules)
        for i, begin, bits in zip(at.tolist(), text_of.tolist(), ended[at].tolist()):
            for r in range(len(self.rules)):
                if bits >> r & 1:
                    found = self.match(r, raw, max(begin, free[r]), i + 1)
                    if found:
                        free[r] = i + 1
                        if found[1]:
                            out.append((found[0], r, i + 1))
        return sorted(out)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan(scanner: Scanner, base: int):
    """Per batch: one pass of the automaton over its texts, then strings for the texts that hold spans."""
    kinds = [r.kind for r in scanner.rules]
    nothing = hashlib.sha256(b"").hexdigest()
    schema = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in kinds[:base]],
                        ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches):
        for b in batches:
            n = b.num_rows
            counts, digest, listed = np.zeros((base, n), np.int64), [nothing] * n, [""] * n
            for s in slices(b.column(1)):
                found = scanner.spans(s.data, s.offsets)
                if not found:
                    continue
                # code points before each byte: bytes that do not continue one
                points = np.concatenate(([0], np.cumsum((s.data & 0xC0) != 0x80)))
                rows: dict[int, list] = {}
                for start, rule, end in found:
                    rows.setdefault(int(np.searchsorted(s.offsets, start, "right")) - 1, []).append((start, rule, end))
                for text, spans in rows.items():
                    zero = points[s.offsets[text]]
                    named = [(r, f"{kinds[r]}:{points[x] - zero}:{points[y] - zero}") for x, r, y in spans]
                    at = s.first + text
                    for r, _ in named:
                        if r < base:
                            counts[r, at] += 1
                    digest[at] = hashlib.sha256(",".join(x for r, x in named if r < base).encode()).hexdigest()
                    listed[at] = ",".join(x for _, x in named)
            yield to_batch(schema, [b.column(0), *counts, digest, listed])
    return run


def scan_secrets(docs: DataFrame, more: tuple[Rule, ...] = MORE_RULES) -> DataFrame:
    """Where every text of ``docs`` (doc_id, text; other columns are ignored) holds secrets.

    One row for each row: doc_id, n_assign, n_access, n_hex and base_sha256 of
    the base rules' spans, and ``spans``: all spans, those of ``more`` rules
    too, as kind:start:end in code points, by start, then in the rules' order.

    Defined cases: null and empty texts have no spans (base_sha256 of the
    empty string); a null doc_id stays null; repeated rows stay; texts of any
    length are scanned whole; bytes beyond ASCII belong to no secret; an empty
    table gives an empty result.  The size of Arrow batches set here stays set
    for the session.
    """
    small_batches(docs.sparkSession)
    scanner = Scanner(BASE_RULES + tuple(more))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(_scan(scanner, len(BASE_RULES)), SCHEMA)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 13 over all documents."""
    return scan_secrets(table(spark, sf_dir, "documents", "doc_id", "text"))


def _sql() -> str:
    """Matches are marked in the text with two code points it does not hold, then measured between the marks."""
    on, off = "chr(57344)", "chr(57345)"
    kept = {"assign": r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
            "access": "(AKIA[A-Z0-9]+)", "hex": "([0-9a-f]+)", "github": "gh[pousr]_([A-Za-z0-9]+)", "slack": "xox[abprs]-([A-Za-z0-9-]+)",
            "google": "AIza([A-Za-z0-9_-]+)", "stripe": "[rs]k_(?:live|test)_([A-Za-z0-9]+)",
            "private": r"-----BEGIN\x20(?:[A-Z]+\x20)*PRIVATE\x20KEY(-{5,})"}
    least = {"assign": 6, "access": 20, "hex": 24, "github": 36, "slack": 10, "google": 35, "stripe": 16, "private": 5}
    parts = []
    for i, (kind, pattern) in enumerate(kept.items()):
        parts.append(f"""
SELECT r, {i} AS kind, '{kind}' AS name, start, start + length(hit) AS stop FROM (
  SELECT r, split_part(piece, {off}, 1) AS hit, pos,
         sum(length(replace(piece, {off}, ''))) OVER (PARTITION BY r ORDER BY pos) - length(replace(piece, {off}, '')) AS start
  FROM (SELECT r, unnest(pieces) AS piece, unnest(range(len(pieces))) AS pos
        FROM (SELECT r, string_split(regexp_replace(text, '{pattern}', {on} || '\\0' || {off}, 'g'), {on}) AS pieces FROM d)))
WHERE pos > 0 AND length(regexp_extract(hit, '{pattern}', 1)) >= {least[kind]}""")
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS MATERIALIZED ({" UNION ALL ".join(parts)}),
g AS (SELECT r, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c,
             string_agg(name || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
             string_agg(name || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, kind) AS spans
      FROM s GROUP BY r)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)
"""


OP13_SQL = _sql()
