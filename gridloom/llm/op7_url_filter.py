"""Allow and block lists of urls by a trie over reversed host labels and, below each host, path segments."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import table

#: Verdict, host, start of the path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Rules that are broadcast with the task; longer lists are refused rather than shipped to every task.
MOST_RULE_BYTES = 64 << 20
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class UrlTrie:
    """``find(host, path)``: the rule of the longest host that fits, and of its rules the one with the longest path.

    A node is [children by label, tree of paths]; a node of a tree of paths is [children by whole segment, {start of the
    next segment: (rule, verdict)}, lengths of these starts, longest first], since a rule's path may end within a segment.
    Of equal rules the first one counts. What a lookup costs is bounded by the rules, however long a url's segments are.
    """

    def __init__(self, rules):
        self.root: list = [{}, None]
        rules = list(rules)
        #: No more segments of a path, and labels of a host, are looked at than rules have.
        self.depth = max((path.count("/") for _, _, path in rules), default=0) + 1
        self.labels = max((host.count(".") for _, host, _ in rules), default=0) + 1
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.translate(UPPER).split(".")):
                node = node[0].setdefault(label, [{}, None])
            if node[1] is None:
                node[1] = [{}, {}, []]
            *whole, last = path.split("/")
            place = node[1]
            for segment in whole:
                place = place[0].setdefault(segment, [{}, {}, []])
            place[1].setdefault(last, (host.translate(UPPER) + path, verdict))
            if len(last) not in place[2]:
                place[2].append(len(last))
                place[2].sort(reverse=True)

    @staticmethod
    def _by_path(tree: list, segments: list[str]):
        found, node = None, tree
        for segment in segments:
            for n in node[2]:
                if n <= len(segment) and segment[:n] in node[1]:
                    found = node[1][segment[:n]]
                    break
            node = node[0].get(segment)
            if node is None:
                break
        return found

    def find(self, host: str, path: str):
        found, node, segments = None, self.root, path.split("/", self.depth)
        for label in reversed(host.rsplit(".", self.labels)):
            node = node[0].get(label)
            if node is None:
                break
            if node[1] is not None:
                found = self._by_path(node[1], segments) or found
        return found


def split_url(url: str | None) -> tuple[str, str]:
    rest = (url or "").partition("://")[2]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    after = rest[end:]
    stop = min((i for i in map(after.find, "?#") if i >= 0), default=len(after))
    return rest[:end].translate(UPPER), after[:stop]


def _judge(batches: Iterator[pa.RecordBatch], held, default: str) -> Iterator[pa.RecordBatch]:
    find = held.value.find
    for batch in batches:
        hosts, paths, rules, verdicts = [], [], [], []
        for url in batch.column("url").to_pylist():
            host, path = split_url(url)
            rule, verdict = find(host, path) or (None, default)
            hosts.append(host)
            paths.append(path)
            rules.append(rule)
            verdicts.append(verdict)
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array(c, pa.string()) for c in (hosts, paths, rules, verdicts))], ["page_id", "host", "path", "rule", "verdict"])


def filter_urls(pages: DataFrame, rules=RULES, default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict.

    A rule fits its host and all subdomains if the url's path starts with the rule's path; the longest host wins, then the
    longest path. Without a rule that fits, rule is null and the verdict is ``default``. A null url, or one without
    ``://``, has an empty host and path and so no rule. A null page_id, repeated rows and repeated ids stay as they
    are. Urls of any length are read whole. Other columns are not read. An empty table gives an empty one.
    No shuffle. The trie is broadcast; the rules may have MOST_RULE_BYTES characters at most.
    """
    rules = list(rules)
    if sum(len(host) + len(path) for _, host, path in rules) > MOST_RULE_BYTES:
        raise ValueError("too many rules to broadcast")
    held = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))
    return pages.selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url").mapInArrow(partial(_judge, held=held, default=default), "page_id long, host string, path string, rule string, verdict string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


SQL = r"""
with a as (
  select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
b as (select page_id, regexp_extract(rest, '^([^/?#]*)', 1) as h, rest from a),
c as (
  select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(substr(rest, length(h) + 1), '^([^?#]*)', 1) as path from b),
r as (
  select *, case
    when ('.' || host) like '%.example.org' and path like '/es/%' then 'example.org/es/'
    when ('.' || host) like '%.example.org' and path like '/en/1%' then 'example.org/en/1'
    when ('.' || host) like '%.org' and path like '/%' then 'org/'
    when ('.' || host) like '%.com' and path like '/fr/%' then 'com/fr/'
    when ('.' || host) like '%.com' and path like '/de/%' then 'com/de/' end as rule from c)
select page_id, host, path, rule,
  case when rule in ('example.org/es/', 'example.org/en/1', 'com/de/') then 'block' else 'allow' end as verdict from r
"""
