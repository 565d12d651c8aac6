"""Centroid clustering, conversation repair and URL filters against plain versions, with planted and odd cases."""

import heapq
import math
import random
import zlib
from hashlib import sha256
from html.parser import HTMLParser
from urllib.parse import urljoin

import numpy as np
import pytest

from ridgeline.llm import conversation_repair, hamerly, queries, url_filter

LONG = (1 << 63) - 1


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# centroid clustering


def plain_clusters(rows, k, dim, rounds=3, scale=64, seed=1):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    own = [[int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale) for x in v] for _, v in kept]
    order = sorted(range(len(kept)), key=lambda j: (sha256(f"{seed}:{'' if kept[j][0] is None else kept[j][0]}".encode()).hexdigest(), kept[j][1]))
    centroids = [own[j] for j in order[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda: [min(range(len(centroids)), key=lambda j: (gap(v, centroids[j]), j)) for v in own]
    for _ in range(rounds):
        at = nearest()
        for j in range(len(centroids)):
            if group := [v for v, a in zip(own, at, strict=True) if a == j]:
                centroids[j] = [sum(x) // len(group) for x in zip(*group, strict=True)]
    at = nearest()
    d = [gap(v, centroids[a]) for v, a in zip(own, at, strict=True)]
    by = {j: min(LONG, sum(x for x, a in zip(d, at, strict=True) if a == j)) for j in set(at)}
    return sorted(((i, a, min(x, LONG), by[a], min(LONG, sum(d)), sha256(",".join(map(str, centroids[a])).encode()).hexdigest()) for (i, _), a, x in zip(kept, at, d, strict=True)), key=repr)


def odd_vectors():
    rng = np.random.default_rng(1)
    rows = [(int(i) % 40 if i % 7 else None, [float(x) for x in rng.normal(0, 1, 4)]) for i in range(60)]
    rows += [(100 + i, [1e30, -3e38, 0.5, float(i % 2)]) for i in range(3)] + [(200, [1e9, 1.0, 1.0, 1.0])]
    rows += [(201, None), (202, [1.0, 2.0]), (203, [1.0, 2.0, math.nan, 1.0]), (204, [1.0, None, 2.0, 3.0]), (205, [math.inf] * 4), (206, [])]
    return rows + [(300, [0.0] * 4)] * 5


@pytest.mark.parametrize("kind", ["array<double>", "array<float>"])
@pytest.mark.parametrize("k", [1, 3, 16, 100])
def test_clusters(spark, kind, k):
    df = spark.createDataFrame(odd_vectors(), f"vec_id long, embedding {kind}")
    assert rows_of(hamerly.clustered(df, k=k, dim=4)) == plain_clusters([tuple(r) for r in df.collect()], k, 4)
    assert hamerly.clustered(df.limit(0), k=k, dim=4).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert hamerly.clustered(df.limit(0), k=k, dim=4).count() == 0


def test_clusters_of_doubles_beyond_all_bounds(spark):
    rows = [(i, [x, -x, 1.0]) for i, x in enumerate([1.7e308, -1.7e308, 1e300, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumnRenamed("vec_id", "Vec_id").withColumnRenamed("Vec_id", "vec_id")
    assert rows_of(hamerly.clustered(df, k=3, dim=3)) == plain_clusters(rows, 3, 3)


def test_bounds_skip_most_full_scans(spark):
    """Well apart groups: after the first rounds almost no row is compared with all centroids, and the answer stays."""
    rng = np.random.default_rng(3)
    centers = rng.normal(0, 50, (8, 16))
    rows = [(i, [float(x) for x in centers[i % 8] + rng.normal(0, 0.1, 16)]) for i in range(2_000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    state, _ = hamerly.clusters(df, k=8, rounds=6, dim=16)
    assert state.selectExpr("max(scanned)").first()[0] < 250
    assert rows_of(hamerly.clustered(df, k=8, rounds=6, dim=16)) == plain_clusters(rows, 8, 16, rounds=6)


# conversation repair


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d == 0:
            out.append((conv, None, None, None))
            continue
        if d == 1:
            text = ""
        if d == 2:
            text = "".join(x for x in text if x not in ".!?")
        if d == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if d == 3 else 1)
    return out


def plain_repair(rows):
    """(cost, audit, repaired) of (role, text, fault), by a search over whole edit sequences in order of cost and letters."""
    want = {0: "su", 1: "u", 2: "a", 3: "u"}
    to = {"s": 1, "u": 2, "a": 3}
    heap, seen = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, state, made = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            return cost, audit, made
        if (i, state) in seen:  # the first one is the cheapest, and the least letters of those
            continue
        seen.add((i, state))
        for x in want[state]:
            if x != "s":
                heapq.heappush(heap, (cost + 3, audit + "I", i, to[x], (*made, f"{'user' if x == 'u' else 'assistant'}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, made))
            if fault in (0, 3):
                more = 3 if fault else 0
                for x in want[state]:
                    if role[:1] == x:
                        heapq.heappush(heap, (cost + more, audit + "K", i + 1, to[x], (*made, f"{role}:{text}")))
                    if x != "s":
                        heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, to[x], (*made, f"{'user' if x == 'u' else 'assistant'}:{text}")))
    raise AssertionError


def plain_conversations(rows):
    groups = {}
    for r in plain_damage(rows):
        groups.setdefault(r[0], []).append(r[1:])
    out, space = [], "\x20\t\n\x0b\x0c\r"
    for conv, own in groups.items():
        own = [r for r in own if r[1] is not None]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, faults, judged = set(), [0] * 4, []
        for _, role, text in own:
            bare = text.rstrip(space)
            fault = 1 if not bare.strip(space) else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
            seen.add((role, text))
            faults[fault] += 1
            judged.append((role, text, fault))
        turns = {t for t, _, _ in own if t is not None}
        gaps = min(LONG, max(turns) - min(turns) + 1 - len(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") or len(a[0][:1] + b[0][:1]) < 2 for a, b in zip(judged[:-1], judged[1:], strict=True))
        cost, audit, made = plain_repair(judged)
        out.append((conv, gaps, *faults[1:], illegal, cost, audit, sha256("\n".join(made).encode()).hexdigest()))
    return sorted(out, key=repr)


def odd_conversations(n=120, seed=5):
    rng = random.Random(seed)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", None, "", "Sx"], ["Yes.", "No!", "cut", "", None, " \t\n", "why? ", "Yes.", "é.", "a\nb."]
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, 12)):
            rows.append((conv if conv else None, None if rng.random() < 0.05 else turn * rng.choice([1, 1, 1, 2]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"{turn} words."))
    rows += [(500, -(1 << 63), "user", "first."), (500, LONG, "assistant", "last.")] + [(501, 3, "user", "same.")] * 9
    dropped = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    return [*rows, (dropped, 0, "user", "gone.")]


RESULT = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


@pytest.mark.parametrize(("most_rows", "parts"), [(10_000, "1"), (3, "3"), (0, "3")])
def test_repair(spark, most_rows, parts):
    rows = odd_conversations(60)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(2)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = conversation_repair.repair(conversation_repair.damaged(df), most_rows)
        assert rows_of(got.select(*RESULT)) == plain_conversations(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repair_of_one_conversation_over_many_tasks(spark):
    """A third and more of all rows in one conversation, dealt over tasks: its fragments give what the whole would."""
    rng = random.Random(8)
    rows = [(7, i, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["One.", "two", f"{i}.", ""])) for i in range(3_000)]
    rows += [(9, i, "user" if i % 2 else "assistant", "Over and over.") for i in range(1_000)] + odd_conversations(20, 2)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        got = conversation_repair.repair(conversation_repair.damaged(df.repartition(4)))
        assert rows_of(got.select(*RESULT)) == plain_conversations(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_repair_of_nothing_and_of_clashing_names(spark):
    df = spark.createDataFrame([(1, 1, "user", "Hi.", 5, "x")], "conv_id long, turn long, role string, text string, part int, own string")
    assert rows_of(conversation_repair.repair(conversation_repair.damaged(df)).select("conv_id")) == [(1,)]
    assert conversation_repair.repair(conversation_repair.damaged(df.limit(0))).count() == 0


# URL filters


class Links(HTMLParser):
    def __init__(self, html):
        super().__init__()
        self.base, self.found, self.text = None, [], False
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if self.text:
            return
        self.text = tag in ("title", "textarea")
        own = dict(reversed([(k, v or "") for k, v in attrs]))
        if tag == "base" and self.base is None and "href" in own:
            self.base = own["href"]
        if tag == "link" and "canonical" in own.get("rel", "").lower().split() and "href" in own:
            self.found.append(own["href"])
        if tag == "meta" and own.get("http-equiv", "").lower() == "refresh" and "url=" in own.get("content", "").lower():
            self.found.append(own["content"].split("=", 1)[1].strip().strip("'\""))

    def handle_endtag(self, tag):
        self.text = self.text and tag not in ("title", "textarea")


def parts_of(url):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    if rest is None:
        return "", "", None
    cut = min((rest.index(x) for x in "/?#" if x in rest), default=len(rest))
    host = "".join(x.lower() if "A" <= x <= "Z" else x for x in rest[:cut])
    tail = rest[cut:].split("#")[0]
    path, mark, query = tail.partition("?")
    return host, path, host + (path or "/") + mark + query


def plain_verdicts(pages, rules):
    def rule_of(host, path):
        fits = [(len(r), r, v) for v, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        return max(fits, default=(0, None, None))[1:]

    near = {}
    for _, url, html in pages:
        key = parts_of(url)[2]
        if key is not None and html and len(html) < 10_000:  # the long ones have no whole tag
            own = Links(html)
            base = urljoin(url, own.base) if own.base else url
            for href in own.found:
                to = urljoin(base, href.strip())
                if to.lower().startswith(("http://", "https://")) and (other := parts_of(to)[2]) != key:
                    near.setdefault(key, set()).add(other)
                    near.setdefault(other, set()).add(key)
    blocked, seen = set(), set()
    for start in near:
        if start in seen:
            continue
        group, todo = {start}, [start]
        while todo:
            new = near[todo.pop()] - group
            group |= new
            todo += new
        seen |= group
        verdicts = {rule_of(*parts_of("://" + k)[:2])[1] for k in group}
        if "block" in verdicts and "allow" not in verdicts:
            blocked |= group
    out = []
    for page_id, url, _ in pages:
        host, path, key = parts_of(url)
        rule, verdict = rule_of(host, path)
        out.append((page_id, host, path, rule, verdict or ("block" if key in blocked else "allow")))
    return sorted(out, key=repr)


RULES = [("block", "bad.test/"), ("allow", "good.test/"), ("block", "good.test/de/"), ("allow", "bad.test/open/x"), ("block", "net/ads")]


def alias_pages():
    link = lambda href, rel="canonical": f'<html><head><title>a <link rel=canonical href="http://bad.test/t"></title><link rel="{rel}" href="{href}"></head>'
    return [
        (1, "http://a.test/1", link("http://bad.test/x")),  # blocked by its alias
        (2, "https://b.test/2?q=1#top", "<META content='5; URL=http://a.test/1' HTTP-EQUIV=Refresh>"),  # and so on
        (3, "http://c.test/3", link("https://good.test/home")),
        (4, "http://c.test/4", link("http://c.test/3") + link("http://bad.test/y")),  # an allow in the class goes first
        (5, "http://d.test/dir/page", link("../up/./z?x=1&amp;y=2")),
        (6, "http://d.test/up/z?x=1&y=2", link("//E.test/p")),
        (7, "http://e.test/p", link("http://sub.bad.test/")),
        (8, "http://good.test/de/1", link("http://f.test/")),
        (9, "http://f.test", ""),
        (10, "http://bad.test/open/xyz", link("http://bad.test/1")),
        (11, "http://g.test/1", "<!-- " + link("http://bad.test/") + " -->"),  # comments say nothing
        (12, "http://g.test/2", f"<script>var x = '{link('http://bad.test/')}';</script>"),
        (13, "http://g.test/3", link("http://bad.test/", rel="alternate")),
        (14, "http://g.test/4", link("mailto:x@bad.test") + link("javascript:void(0)")),
        (15, "http://h.test/a/b", f'<base href="http://bad.test/dir/">{link("c")}'),
        (16, "http://h.test/a/c", f'<base href="/other/">{link("c")}'),
        (17, "http://h.test/other/c", None),
        (18, None, link("http://bad.test/")),
        (19, "no-scheme", link("http://bad.test/")),
        (20, "http://ÄB.Test/é", link("http://bad.test/é")),
        (21, "http://i.test/1", "<link title='rel=canonical > x' href='http://bad.test/' rel=nofollow>"),
        (22, "http://i.test/2", "<link data-rel=canonical rel='next canonical' href=http://bad.test/q>"),
        (23, "http://i.test/3", "<link " + '"" ' * 20_000 + "rel=canonical"),  # a tag without end
        (29, "http://i.test/4", "<link " * 20_000 + "x" * 20_000 + " rel=canonical href='http://bad.test/'"),
        (24, "http://a.test/1", None),
        (24, "http://a.test/1", None),
        (25, "http://x.net/ads.js", ""), (26, "http://x.net", ""), (27, "http://net/ads", ""), (28, "http://xnet/ads", ""),
    ] + [(100 + i, f"http://chain.test/{i}", link(f"/{i + 1}")) for i in range(12)] + [(200, "http://chain.test/12", link("http://bad.test/end"))]


@pytest.mark.parametrize("table", [False, True])
def test_verdicts(spark, table):
    pages = alias_pages()
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("alias", df_lit()).repartition(3)
    rules = spark.createDataFrame([*RULES, ("block", "good.test/"), (None, "x"), ("block", None)], "verdict string, rule string") if table else RULES
    got = url_filter.judge(df, rules)
    assert rows_of(got.select("page_id", "host", "path", "rule", "verdict")) == plain_verdicts(pages, RULES)
    assert url_filter.judge(df.limit(0), rules).count() == 0


def df_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_redirects_are_aliases(spark):
    pages = spark.createDataFrame([(1, "http://a.test/1", None), (2, "http://z.test/", "")], "page_id long, url string, html string")
    redirects = spark.createDataFrame([("http://a.test/1", "HTTPS://A.test/2#x"), ("http://a.test/2", "http://bad.test/"), (None, "http://z.test/"), ("http://z.test/", None)], "url string, target string")
    got = url_filter.judge(pages, RULES, redirects).select("page_id", "verdict")
    assert rows_of(got) == [(1, "block"), (2, "allow")]


def test_new_queries_against_their_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("embeddings", "conversations", "pages"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    for name in ("op11_hamerly", "op12_conversation_repair", "op13_url_filter"):
        df, want = queries.queries()[name](spark, sf_dir), con.sql(queries.oracle_sql()[name])
        columns = sorted(df.columns)
        assert columns == sorted(want.columns)
        at = [want.columns.index(c) for c in columns]
        assert rows_of(df.select(*columns)) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
