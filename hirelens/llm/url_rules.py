"""URL filters: rules found by their rarest literal token, then matched by regular expressions.

Host rules (``org/``, ``example.org/en/1``) fit a host with all its subdomains and every
path that starts as the rule's does; the longest that fits decides. Where none fits, wildcard
patterns decide: ``||`` ties a pattern to the start of a host or one of its labels, ``|`` to
the start or end of the url, ``^`` is a separator or the end, ``*`` is anything.

Every rule must contain its literal tokens (runs of letters and digits that are complete in
the rule). The rule is filed under the one that is rarest in the table's own urls, so a url
fetches few rules, by its own tokens, and only these run their regular expressions.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
#: Characters of rules and patterns together; the index is sent to every executor.
MAX_RULE_CHARS = 16_000_000
TOKEN = re.compile("[0-9a-z]+")
ASCII_LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
RESULT = "struct<host: string, path: string, rule: string, verdict: string, pattern: string>"


def host_path(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    return host.translate(ASCII_LOWER), path


def _host_rule(rule: str) -> tuple[str, list[str]]:
    """The expression for host + path, and the complete tokens, of a host rule."""
    host, _, path = rule.partition("/")
    host, path = host.translate(ASCII_LOWER), f"/{path}"
    literal = f"{host}{path}".translate(ASCII_LOWER)
    tokens = [m[0] for m in TOKEN.finditer(literal) if m.end() < len(literal)]
    return rf"(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tokens


def _pattern(pattern: str) -> tuple[str, list[str]]:
    """The expression for a whole url in lower case, and the complete tokens, of a pattern."""
    text = pattern.translate(ASCII_LOWER)
    anchors = r"\|\||\||\^|\*"
    parts = [x for x in re.split(f"({anchors})", text) if x]
    out, tokens = [], []
    for i, x in enumerate(parts):
        if x == "||" and i == 0:
            out.append(r"^[^/?#]*://(?:[^/?#]*\.)?")
        elif x == "|" and i == 0:
            out.append("^")
        elif x == "|" and i == len(parts) - 1:
            out.append(r"\Z")
        elif x == "^":
            out.append(r"(?:[^0-9a-z%._-]|\Z)")
        elif x == "*":
            out.append("(?s:.*)")
        else:
            out.append(re.escape(x))
            open_left = i == 0 or parts[i - 1] == "*"
            open_right = i == len(parts) - 1 or parts[i + 1] == "*"
            for m in TOKEN.finditer(x):
                if not (open_left and m.start() == 0 or open_right and m.end() == len(x)):
                    tokens.append(m[0])
    return "".join(out), tokens


class Index:
    """Rules by the token they are filed under; under none those without a complete token."""

    def __init__(self, rules: Sequence[tuple[str, str]], patterns: Sequence[tuple[str, str]]):
        if sum(len(r) for _, r in (*rules, *patterns)) > MAX_RULE_CHARS:
            raise ValueError(f"rules and patterns have more than {MAX_RULE_CHARS} characters")
        self.entries = [(v, r, *_host_rule(r), True) for v, r in rules]
        self.entries += [(v, p, *_pattern(p), False) for v, p in patterns]
        self.filed: dict[str, list[int]] = defaultdict(list)
        self.compiled: dict[int, re.Pattern] = {}

    def tokens(self) -> set[str]:
        return {t for e in self.entries for t in e[3]}

    def file(self, counts: dict[str, int]) -> None:
        for i, entry in enumerate(self.entries):
            rarest = min(entry[3], key=lambda t: (counts.get(t, 0), -len(t), t), default="")
            self.filed[rarest].append(i)

    def _fits(self, i: int, text: str) -> bool:
        expression = self.compiled.get(i)
        if expression is None:
            expression = self.compiled[i] = re.compile(self.entries[i][2])
        return (expression.match if self.entries[i][4] else expression.search)(text) is not None

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, str | None]:
        """Host, path, rule, verdict, and the pattern that decided if no rule did."""
        host, path = host_path(url)
        whole, lower = host + path, (url or "").translate(ASCII_LOWER)
        fetched = {i for t in {"", *TOKEN.findall(lower)} for i in self.filed.get(t, ())}
        rules = [i for i in fetched if self.entries[i][4] and self._fits(i, whole)]
        if rules:
            verdict, rule = min(
                (self.entries[i][:2] for i in rules), key=lambda e: (-len(e[1]), e[0] == ALLOW, e[1])
            )
            return host, path, rule, verdict, None
        hits = [self.entries[i][:2] for i in fetched if not self.entries[i][4] and self._fits(i, lower)]
        verdict, pattern = min(hits, key=lambda e: (e[0] == BLOCK, -len(e[1]), e[1]), default=(ALLOW, None))
        return host, path, None, verdict, pattern


def token_counts(urls: DataFrame, url_col: str, tokens: set[str]) -> dict[str, int]:
    """Urls in which each of the rules' tokens stands; at most as many rows as tokens. The tokens
    (``MAX_RULE_CHARS`` bounds them) go to the urls, so that a frequent one is counted where it stands."""
    spark = urls.sparkSession
    lower = F.translate(F.col(url_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = urls.select(F.explode(F.array_distinct(F.split(lower, "[^0-9a-z]+"))).alias("token"))
    wanted = spark.createDataFrame([(t,) for t in sorted(tokens)], "token string")
    return {r.token: r.n for r in found.join(F.broadcast(wanted), "token").groupBy("token").agg(F.count("*").alias("n")).collect()}


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    patterns: Sequence[tuple[str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """(id_col, host, path, rule, verdict, pattern), one row per row of ``pages``.

    ``rules`` and ``patterns`` are (verdict, text) pairs. Of the host rules that fit, the
    longest decides, of equally long ones a blocking one. Without one, an allowing pattern
    goes before a blocking one, and a url that nothing fits is allowed. A null url, or one
    without ``://``, has an empty host and path, which no host rule fits. Repeated rows are
    judged each. An empty table gives an empty result.
    """
    urls = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"))
    index = Index(rules, patterns)
    tokens = index.tokens()
    index.file(token_counts(urls, "url", tokens) if tokens else {})

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [index.judge(u) for u in batch.to_pylist()]
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.StructArray.from_arrays(
                [pa.array(c, pa.string()) for c in columns], ["host", "path", "rule", "verdict", "pattern"]
            )

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    judged = urls.select("page", F.arrow_udf(run, RESULT)("url").alias("j"))
    return judged.select(F.col("page").alias(id_col), "j.*")
