"""URL filters and mixing against plain versions."""

import hashlib

import duckdb
import re

import pytest

from pipelens.llm import mixing, queries, urlfilter

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("Odd.org", "/pre", "block"), ("odd.org", "/pre", "allow"), ("x.y", "", "block"), (None, "/", "block")]
URLS = [
    "http://EXAMPLE.com/en/1", "https://www.example.com/en/?q", "https://a.b.www.example.com/en/x#f", "http://example.com/enx", "http://example.com", "http://example.com/", "ftp://u:p@example.com:80/en/", None, "", "no scheme",
    "://", "http://a.net/es/", "http://net/es/1", "http://xnet/es/1", "http://a.net/es", "http://odd.org/prefix", "http://ODD.ORG/pre", "http://x.y", "http://z.x.y?x", "http://..com/a", "http://com./", "http://a.com/" + "d/" * 3000, "http://h.com/a://b.net/es/", "http://ünï.com/é/",
    "http://example.com\nx/en/1",
]


def plain(url):
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = low(re.split("[/?#]", rest, maxsplit=1)[0])
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    fits = [(len(low(h) + p), v == "block", low(h) + p, v) for h, p, v in RULES if h is not None and (host == low(h) or host.endswith("." + low(h))) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def test_urls(spark):
    rows = [(i, u, "old") for i, u in enumerate(URLS)] + [(3, URLS[3], "old"), (None, URLS[0], "old")]
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, rule string"), rules)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    want = sorted(((i, u, *plain(u)) for i, u, _ in rows), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_urls_without_rules_or_rows(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert urlfilter.judge(pages, none, default="block").first().verdict == "block"
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert urlfilter.judge(pages.where("page_id > 1"), rules).count() == 0


def test_urls_stay_in_the_jvm(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    plan = urlfilter.judge(spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string"), rules)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan.split("== Physical Plan ==")[1].replace("PythonRDD", ""))


def reshared(sizes):
    """Targets by sharing again and again what exceeds three times a source."""
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, left = dict.fromkeys(sizes, 0.0), float(sum(sizes.values()))
    open_ = set(sizes)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = sum(max(0.0, target[s] - 3 * sizes[s]) for s in open_)
        open_ = {s for s in open_ if target[s] < 3 * sizes[s]}
        target = {s: min(t, 3.0 * sizes[s]) for s, t in target.items()}
    return target


ROWS = [(i, f"s{i % 5}" if i % 11 else None, "w " * ((i * 37) % 90 if i % 5 else 3)) for i in range(400)]
ROWS += [(1000, "big", "long " * 5000), (1001, "s1", None), (1002, "s1", ""), (None, "s2", "a b c"), (7, "s2", "same row"), (7, "s2", "same row"), (1003, "blank", " \n "), (1004, "é", "x\u00a0y z\x1cw")]


def test_targets_and_taken_words(spark):
    df = spark.createDataFrame([(*r, 1, 2.0) for r in ROWS], "doc_id long, source string, text string, copies int, position double")
    got = mixing.assign(df).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals: dict = {}
    for _, s, t in ROWS:
        totals[s] = totals.get(s, 0) + size(t)
    want = reshared(totals)
    assert len(got) == len(ROWS)
    taken: dict = {}
    for r in got:
        assert r.source_size == totals[r.source] and r.target == pytest.approx(want[r.source]) and r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(2, 0.02 * t) or s == "big"
    again = mixing.assign(df.repartition(7)).collect()
    key = lambda r: (repr(r.doc_id), repr(r.source), r.size, r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_positions_follow_the_schedule(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, source string, text string")
    got = mixing.mix(df, position="t").collect()
    t = [r.t for r in got]
    assert t == sorted(t) and all(0 <= x <= 1 for x in t)
    copies = {(r.doc_id, r.source, r.text) for r in got}
    assert copies <= {*ROWS}
    # sources of weight 1 are denser in the first half, those of weight 3 in the second
    names = sorted({s for _, s, _ in ROWS if s is not None}) + [None]
    early = lambda w: [sum(len((r.text or "").split()) for r in got if names.index(r.source) % 3 + 1 == w and half(r.t)) for half in (lambda x: x < 0.5, lambda x: x >= 0.5)]
    a, b = early(1), early(3)
    assert a[0] > a[1] and b[0] < b[1]


def test_order_is_by_the_hash_of_the_id(spark):
    rows = [(i, "a", "one two three") for i in range(50)] + [(100 + i, "b", "x") for i in range(300)]
    got = {r.doc_id: r.copies for r in mixing.assign(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    ids = sorted(range(100, 400), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    extra = [got[i] for i in ids]
    assert extra == sorted(extra, reverse=True)


def test_empty_mix(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.assign(empty).count() == 0 and mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, "a", ""), (2, None, None)], "doc_id long, source string, text string")
    assert [r.taken for r in mixing.assign(blank).collect()] == [0, 0] and mixing.mix(blank).count() == 0


def test_documents_that_do_not_fit_are_passed_over(spark):
    """A source whose target is less than one document that comes early, with others of middle size."""
    hashed = sorted(range(500), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    sizes = {i: 100 for i in hashed} | {hashed[20]: 50_000, hashed[60]: 21_000, hashed[90]: 9_000, hashed[100]: 7, hashed[480]: 3}
    rows = [(i, "a", "w " * n) for i, n in sizes.items()] + [(1000 + i, "b" if i % 2 else "c", "w " * 100) for i in range(800)] + [(3000, None, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.assign(df, refill=True).collect()
    for s in ("a", "b", "c", None):
        own = [r for r in got if r.source == s]
        whole = min(3, int(own[0].target // own[0].source_size))
        gap = own[0].target - sum(r.taken for r in own)
        untaken = [r.size for r in own if r.copies == whole]
        assert all(r.copies in (whole, whole + 1) for r in own)
        assert abs(gap) <= 50 and (whole == 3 or all(z > gap for z in untaken)), (s, gap)
    mixed = mixing.mix(df, position="t").collect()
    assert len(mixed) == sum(r.copies for r in got)
    # the copies lie where the integral of the schedule, 1.5 t - 0.5 t^2 of the target, meets the running sum of what is taken
    before, target = 0, next(r.target for r in got if r.source == "a")
    for r in (r for r in mixed if r.source == "a"):
        size = len(r.text.split())
        assert r.t == 1 or (1.5 * r.t - 0.5 * r.t**2) * target == pytest.approx(before + size / 2)
        before += size
    assert sum(r.t == 1 for r in mixed if r.source == "a") <= 1


def test_query_has_the_positions_of_all_copies(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "doc_id long, source string, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op6_mix(spark, str(tmp_path)).collect()
    assert all(len(r.positions) == r.copies and r.positions == sorted(r.positions) for r in got)
    want = sorted(r.t for r in mixing.mix(df, position="t").collect())
    assert sorted(t for r in got for t in r.positions) == pytest.approx(want)
    first = [r.first_position for r in got]
    taken = [t for t in first if t is not None]
    assert first == sorted(taken) + [None] * (len(first) - len(taken)) and taken


def test_query_meets_the_targets_whatever_comes_first(spark, tmp_path):
    """Three sources of 500 documents of 100 words, one of them with a document that is larger than all others together; the SQL says the same."""
    for n, at in enumerate((0, 7, 250)):
        rows = [(i, "abc"[i // 500], "w " * 100) for i in range(1500)] + [(9000 + at, "a", "w " * 50_000), (9999, "c", "odd size " * 9), (9999, "c", "odd size " * 9)]
        path = f"{tmp_path}/{n}"
        spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{path}/documents.parquet")
        got = queries.op6_mix(spark, path).collect()
        for s, size in (("a", 100_000), ("b", 50_000), ("c", 50_036)):
            own = [r for r in got if r.source_size == size]
            whole = min(3, int(own[0].target // size))
            smallest = min((r.size for r in own if r.copies == whole), default=0)
            assert abs(sum(r.taken for r in own) - own[0].target) <= max(smallest, 100), (s, at)
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS FROM read_parquet('{path}/documents.parquet/*.parquet')")
        want = con.execute(queries.ORACLE_SQL["op6_mix"])
        names = [d[0] for d in want.description]
        assert sorted(([tuple(r[n] for n in names) for r in got]), key=repr) == sorted(want.fetchall(), key=repr)


def test_a_rule_fits_no_other_split_of_its_text(spark):
    rules = spark.createDataFrame([("a.co", "m/", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/"), (2, "http://x.a.com/b")] + [(3, None)] * 5, "page_id long, url string")
    assert [r.verdict for r in urlfilter.judge(pages, rules).collect()] == ["allow"] * 7
