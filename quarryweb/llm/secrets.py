"""Secret scan: one minimal automaton for all rules, one byte pass over each text."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryweb.llm.automaton import Dfa, compile_dfa
from quarryweb.llm.common import table, whole_text

SPANS = "array<struct<kind:string,start:int,end:int>>"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


@dataclass(frozen=True)
class Rule:
    """A secret is head followed by value. Matches are leftmost, longest and do not overlap those of the same rule;
    one that is too short is dropped after it was matched, so it still hides what it covers.

    first is how every value begins. The automaton of all rules looks for head and first only: that finds every
    match, and the runs that follow need no states there (with them it has over 25,000). From there the rule's own
    automata read back to the leftmost start and on to the end. Of two heads of one rule, that which ends later also
    begins later, as in all rules here.
    """

    kind: str
    head: str
    first: str
    value: str
    min_value: int = 1
    min_total: int = 1


#: The three base rules come first; the others add spans.
RULES = (
    Rule("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?", "[A-Za-z0-9+/_.=-]", "[A-Za-z0-9+/_.=-]+", min_value=6),
    Rule("access", "AKIA", "[A-Z0-9]", "[A-Z0-9]+", min_total=20),
    Rule("hex", "", "[0-9a-f]{24}", "[0-9a-f]{24,}", min_total=24),
    Rule("private_key", r"-----BEGIN\x20([A-Z0-9]+\x20)*PRIVATE\x20KEY-----", "", r"[\x0A\x0DA-Za-z0-9+/=]*", min_value=0),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ", "[A-Za-z0-9_-]", r"[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", min_total=40),
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]", "[A-Za-z0-9]+", min_value=36),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]", "[A-Za-z0-9-]+", min_value=10),
    Rule("google", "AIza", "[A-Za-z0-9_-]", "[A-Za-z0-9_-]+", min_value=35),
    Rule("stripe", "[sr]k_live_", "[A-Za-z0-9]", "[A-Za-z0-9]+", min_value=16),
    Rule("url_login", r"[A-Za-z]://[A-Za-z0-9_.%+-]+:", "[A-Za-z0-9_.%+!$*~-]", r"[A-Za-z0-9_.%+!$*~-]+@", min_value=5),
)
BASE_KINDS = ("assign", "access", "hex")


class Scanner:
    """One pass over the bytes by the automaton of all rules; what it finds is closed by the rule's own two, of which one reads back to the start.

    Each byte is read once in the pass, and then about once more for each rule
    whose head, or whose match, it is in: a rule's heads do not overlap those
    before, and a place that is inside a rule's match is not looked at again.
    """

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        whole = [f"({r.head})({r.value})" for r in rules]
        begins = [f"({r.head})({r.first})" for r in rules]
        self.all: Dfa = compile_dfa(begins, search=True, finer=whole)
        code = self.all.byte_class
        self.one = [compile_dfa([w], search=False, classes=code) for w in whole]
        self.back = [compile_dfa([b], search=False, classes=code, backward=True) for b in begins]
        self.head = [compile_dfa([r.head], search=False, classes=code) if r.head else None for r in rules]

    def scan(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, by start, then rule."""
        data = text.encode("utf-8", "surrogatepass")
        dfa = self.all
        coded, nxt, hot, accepts, s = data.translate(dfa.byte_class), dfa.next, dfa.hot, dfa.accepts, dfa.start
        after = [0] * len(self.rules)  # where each rule's last match ends
        found: list[tuple[int, int, int]] = []
        for i, c in enumerate(coded, 1):
            s = nxt[s + c]
            if s >= hot:
                for k in accepts[s]:
                    while after[k] < i and (begin := self.back[k].leftmost(coded, i, after[k])) >= 0 and (end := self.one[k].longest(coded, begin)) > 0:
                        after[k] = end
                        value = self.head[k].longest(coded, begin) if self.head[k] else begin
                        if end - value >= self.rules[k].min_value and end - begin >= self.rules[k].min_total:
                            found.append((begin, k, end))
        found.sort()
        if len(data) == len(text):
            return [(self.rules[k].kind, b, e) for b, k, e in found]
        point, at, n = {}, 0, 0
        for b in sorted({x for b, _, e in found for x in (b, e)}):
            n += len(data[at:b].decode("utf-8", "surrogatepass"))
            at, point[b] = b, n
        return [(self.rules[k].kind, point[b], point[e]) for b, k, e in found]


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    """The compiled rules, once in each Python worker."""
    return Scanner(rules)


def secret_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """array<struct<kind,start,end>> of a text column; null and empty texts have none."""

    @F.arrow_udf(SPANS)
    def find(texts: pa.Array) -> pa.Array:
        scan = scanner(rules).scan
        rows = ([{"kind": k, "start": s, "end": e} for k, s, e in scan(x.as_py() or "")] for x in texts)
        return pa.array(rows, _ARROW_SPANS)

    return find(text)


def find_secrets(df: DataFrame, text_col: str = "text", out_col: str = "secret_spans", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with the spans of every secret of every whole text.

    Null and empty texts get an empty list; repeated rows are scanned alike;
    an empty table stays empty; a column named out_col is replaced and all
    others are kept as they are. No shuffle.
    """
    return df.withColumn(out_col, secret_spans(F.col(text_col), rules))


def redact_secrets(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """df with each secret of text_col replaced by mark; overlapping spans are replaced together.

    Null texts stay null, texts without secrets stay as they are, and all
    columns keep their names and types.
    """

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        scan, out = scanner(rules).scan, []
        for x in texts:
            text = x.as_py()
            parts, at = [], 0
            for _, s, e in scan(text or ""):
                if s >= at:
                    parts += [text[at:s], mark]
                at = max(at, e)
            out.append("".join([*parts, text[at:]]) if parts else text)
        return pa.array(out, pa.string())

    return df.withColumn(text_col, clean(F.col(text_col)))


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Counts of base kinds, digest of base spans, and all spans, for every document."""
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", whole_text().alias("text"))).drop("text")
    spans, s = F.col("secret_spans"), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    of = lambda *kinds: F.filter(spans, lambda x: x["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(F.array_join(F.transform(of(*BASE_KINDS), s), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(spans, s), ",").alias("spans"),
    )


def _sql_spans(k: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Spans of one kind: the texts between matches tell where each match is."""
    return f"""
    SELECT rid, {k} AS k, '{kind}' AS kind, s, s + n AS e FROM (
        SELECT rid, list_sum(list_transform(gaps[1 : i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(hits[1 : i - 1], lambda x: length(x))), 0)::BIGINT AS s, length(hits[i]) AS n, length(vals[i]) AS v
        FROM (SELECT rid, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}', 0) AS hits, regexp_extract_all(text, '{pattern}', {group}) AS vals FROM d WHERE regexp_matches(text, '{pattern}')) AS x, unnest(range(1, len(hits) + 1)) AS t(i))
    WHERE v >= {least}"""


#: Patterns of the rules as plain regexes: kind, pattern, and the group of which the length counts, with the least.
_SQL_RULES = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("private_key", r"-----BEGIN\x20(?:[A-Z0-9]+\x20)*PRIVATE\x20KEY-----[\x0A\x0DA-Za-z0-9+/=]*", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    ("github", "gh[pousr]_([A-Za-z0-9]+)", 1, 36),
    ("slack", "xox[abprs]-([A-Za-z0-9-]+)", 1, 10),
    ("google", "AIza([A-Za-z0-9_-]+)", 1, 35),
    ("stripe", "[sr]k_live_([A-Za-z0-9]+)", 1, 16),
    ("url_login", "[A-Za-z]://[A-Za-z0-9_.%+-]+:([A-Za-z0-9_.%+!$*~-]+@)", 1, 5),
)
OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(_sql_spans(k, *rule) for k, rule in enumerate(_SQL_RULES))}),
g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c,
      string_agg(concat_ws(':', kind, s, e), ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(concat_ws(':', kind, s, e), ',' ORDER BY s, k) AS spans FROM f GROUP BY rid)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)
"""
