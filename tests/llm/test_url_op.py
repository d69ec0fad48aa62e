import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from wearline.llm import url_filters as uf
from wearline.llm.queries import BLOCKED_WORDS, URL_RULES, op3_url_filter


def test_levels_answer_exactly_for_the_universe():
    rng = np.random.default_rng(3)
    for size, share in ((1, 1.0), (50_000, 0.1), (20_000, 0.0), (20_000, 1.0), (3000, 0.9)):
        h1, h2 = rng.integers(-2 ** 63, 2 ** 63 - 1, size=(2, size))
        listed = rng.random(size) < share
        levels = uf.build_levels(h1, h2, listed)
        assert (uf.member(levels, h1, h2) == listed).all()
    h1, h2 = rng.integers(-2 ** 63, 2 ** 63 - 1, size=(2, 100_000))
    listed = np.arange(100_000) < 5000
    levels = uf.build_levels(h1, h2, listed)
    assert len(levels) > 2 and sum(x.size for x in levels) < 5000 * 16


def by_hand(url, rules, blocked):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    verdict = best.action if best else "block" if host in blocked else "allow"
    return host, path, best and best.host + best.path, verdict


def test_whole_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    hosts = {by_hand(p.url, [], ())[0] for p in pages}
    blocked = {h for h in hosts if set(h.replace("-", ".").split(".")) & set(BLOCKED_WORDS)}
    assert blocked
    found = {r.page_id: tuple(r)[1:] for r in op3_url_filter(spark, SF).collect()}
    assert found == {p.page_id: by_hand(p.url, URL_RULES, blocked) for p in pages}


URLS = [None, "", "no scheme", "http://", "://x", "http://NET/", "http://a.net", "http://a.net?x=/", "http://a.net/",
        "http://example.net/en/", "http://x.EXAMPLE.net/en/a?b#c", "http://notexample.net/en/", "http://example.net/en",
        "http://example.com/de/", "http://é.org/fr/ü", "http://org/fr/", "http://example.net:80/en/", "a://b://c/d",
        "http://bad.test/x", "http://bad.test/x", "http://u@a.net/" + "y" * 100_000, "http://a..net/\n?"]


@pytest.mark.parametrize("most", [uf.BROADCAST_BYTES, -1])
def test_odd_urls_sent_or_streamed(spark, monkeypatch, most):
    monkeypatch.setattr(uf, "SHARD_KEYS", 3)
    pages = spark.createDataFrame([(i, u, "?", "?") for i, u in enumerate(URLS)],
                                  "page_id long, url string, host string, _keys string")
    blocked = spark.createDataFrame([("bad.test",), ("never.seen",), (None,)], "h string")
    result = uf.judge_urls(pages, URL_RULES, blocked, most_bytes=most)
    assert {r.page_id: tuple(r)[1:] for r in result.collect()} == {
        i: by_hand(u, URL_RULES, {"bad.test"}) for i, u in enumerate(URLS)}


@pytest.mark.parametrize("most", [uf.BROADCAST_BYTES, -1])
def test_many_keys_in_many_shards(spark, monkeypatch, most):
    monkeypatch.setattr(uf, "SHARD_KEYS", 500)
    keys = spark.range(6000).select(F.concat(F.lit("k"), "id").alias("key"), "id")
    cascade = uf.build_cascade(keys.where("id % 7 = 0").select("key"), keys.select("key"))
    assert cascade.shards == 12
    rows = keys.union(keys.where("id = 7")).select("key", "id", F.lit(1).alias("x"))
    found = uf.contains(rows, [uf.Question("key", cascade, "listed")], most)
    assert found.count() == 6001 and found.where("listed != (id % 7 = 0)").count() == 0


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    nothing = spark.createDataFrame([], "h string")
    assert uf.judge_urls(pages, URL_RULES, nothing).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert uf.judge_urls(one, [], nothing).first().verdict == "allow"
