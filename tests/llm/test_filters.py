from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from aftershock.llm import poisson_mix, site_lines, toxicity, url_boost
from aftershock.llm.queries import RULES
from tests.llm.conftest import prose


def test_boilerplate_lines_go_and_copies_of_a_page_count_once(spark):
    rows = [(i, "a", f"menu\nown text {i}\n" + ("ad\n" if i < 2 else "") + "\nend") for i in range(30)]
    rows += [(100 + i, "a", "a copied page\nwith two lines") for i in range(30)]
    rows += [(200 + i, "few", "menu") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r for r in site_lines.drop_site_lines(docs).collect()}
    assert got[7].text == "own text 7\n" and (got[7].lines, got[7].dropped) == (4, 2)
    assert got[0].text == "own text 0\nad\n"
    assert all(got[100 + i].text == "a copied page\nwith two lines" for i in range(30))
    assert all(got[200 + i].dropped == 0 for i in range(5))


def test_lines_of_hostile_documents(hostile, empty):
    got = site_lines.drop_site_lines(hostile, least_holders=2, max_ratio=0.3)
    assert set(got.columns) == {*hostile.columns, "lines", "dropped"}
    texts = Counter((r.doc_id, r.text) for r in got.collect())
    assert texts[3, None] == 1 and texts[4, ""] == 1 and texts[2, "own line two"] == 2
    assert texts[None, "without an id"] == 1 and texts[9, "one"] == 1
    assert got.filter("doc_id = 3").first().lines == 0
    assert site_lines.drop_site_lines(empty).collect() == []


@pytest.mark.parametrize("pages", [40, 400, 3000])
def test_planted_lines_go_and_clean_lines_stay_at_every_size(spark, pages):
    """Boilerplate on a twentieth of the pages, passages of 60 words on a hundredth (three pages at least), near copies."""
    passages = [prose(9000 + i, 60) for i in range(4)]
    family = [prose(8000 + i, 12, 10**6) for i in range(6)]
    rows, planted = [], set()
    for i in range(pages):
        lines = [prose(i * 31 + j, 12, 10**6) for j in range(5)]
        if i % 20 < 2 or i < 4:
            lines.insert(2, f"Posted in {i % 2} by the editors")
            planted.add((i, lines[2]))
        if i % 100 < 1 or i < 3:
            lines.insert(1, passages[i % 2])
            planted.add((i, passages[i % 2]))
        rows.append((i, "\n".join(lines), f"site{i % 2}"))
    copies = [(pages + i, "\n".join([*family, f"edit {i}"]), "site0") for i in range(max(3, pages // 40))]
    docs = spark.createDataFrame(rows + copies, "doc_id long, text string, source string")
    got = {r.doc_id: set((r.text or "").split("\n")) for r in site_lines.drop_site_lines(docs).collect()}
    counts = Counter((rows[i][2], line) for i, line in planted)
    caught = [line not in got[i] for i, line in planted if counts[rows[i][2], line] >= 3]
    assert len(caught) > pages / 50 and sum(caught) >= 0.9 * len(caught)
    clean = [line in got[i] for i, text, _ in rows for line in text.split("\n") if (i, line) not in planted]
    assert sum(clean) >= 0.99 * len(clean)
    assert all(got[i] == set(text.split("\n")) for i, text, _ in copies)


def test_sites_by_host(spark):
    pages = [(i, f"ad\nown {i} and more than half", f"HTTP://WWW.{'ab'[i % 2]}.org/p?u={i}") for i in range(8)]
    docs = spark.createDataFrame(pages, "doc_id long, text string, url string")
    got = site_lines.drop_site_lines(docs, site=site_lines.host_of(F.col("url")), least_holders=4, max_ratio=0.9)
    assert all(r.text.startswith("own") and r.dropped == 1 for r in got.collect())


def poisson(mean: float, u: float) -> int:
    p = reached = math.exp(-mean)
    k = 0
    while reached <= u:
        k += 1
        p *= mean / k
        reached += p
    return k


def test_copies_invert_the_distribution(spark):
    rows = [(i, "big" if i % 3 else "small", "x" * (i % 50)) for i in range(2000)] + [(5000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mixed = poisson_mix.mix_sources(docs, weights={"big": 1.0, "small": 3.0})
    got = Counter(r.doc_id for r in mixed.collect())
    sizes = defaultdict(int)
    for _, source, text in rows:
        sizes[source] += len(text or "")
    rates = {"big": 0.25 * sum(sizes.values()) / sizes["big"], "small": 0.75 * sum(sizes.values()) / sizes["small"], None: 1.0}
    units = docs.select("doc_id", "source", poisson_mix.unit(poisson_mix.SEED, F.col("doc_id"), F.lit(1)).alias("u"))
    for row in units.collect():
        assert got[row.doc_id] == poisson(rates[row.source], row.u)


@pytest.mark.parametrize("few", [0, 10_000])
def test_shares_follow_weights_also_for_high_rates(spark, monkeypatch, few):
    monkeypatch.setattr(poisson_mix, "FEW_SOURCES", few)
    rows = [(i, "rare" if i < 20 else "common", "x" * 100) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mixed = poisson_mix.mix_sources(docs, weights={"rare": 0.5, "common": 0.5}).groupBy("source").count()
    counts = {r["source"]: r["count"] for r in mixed.collect()}
    assert abs(counts["rare"] - 2000) < 200 and abs(counts["common"] - 2000) < 200


def test_documents_without_an_id_are_drawn_by_their_texts(spark):
    rows = [(i if i % 2 else None, "a", f"text {i}") for i in range(4000)] + [(None, "a", "text 0")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mixed = poisson_mix.mix_sources(docs).collect()
    for of in (lambda i: i is None, lambda i: i is not None):
        own = [r for r in mixed if of(r.doc_id)]
        assert 1800 < len(own) < 2200 and 1150 < len({r.text for r in own}) < 1380
    copies = Counter((r.text, r.copy) for r in mixed)
    assert all(n == (3 if text == "text 0" else 1) for (text, _), n in copies.items())


def test_mix_of_hostile_documents(hostile, empty):
    mixed = poisson_mix.mix_sources(hostile)
    assert set(mixed.columns) == {*hostile.columns, "rate", "copy"}
    counts = Counter((r.doc_id, r.copy) for r in mixed.collect())
    assert all(n == 2 for (i, _), n in counts.items() if i == 2)
    assert mixed.collect() == poisson_mix.mix_sources(hostile).collect()
    assert poisson_mix.mix_sources(empty).collect() == []


def host_and_path(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    return host, rest[cut:].split("?")[0].split("#")[0]


URLS = [
    None,
    "",
    "no scheme",
    "http://",
    "HTTP://A.Example.NET/en/x?y=://z#t",
    "http://example.net/EN/1",
    "http://notexample.com/de/",
    "http://example.com/de/7",
    "https://x.org/fr/",
    "https://org/fr/9",
    "http://net",
    "http://net/",
    "http://a.net?x/en/",
    "http://a.example.net:80/en/",
    "http://x.example.com/de/" + "9" * 5000,
    "http://É.example.com/de/\nline",
]


def test_rules_decide_and_the_longest_wins(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string, salt string")
    for row in url_boost.judge_urls(pages, RULES, rounds=2).collect():
        host, path = host_and_path(URLS[row.page_id % len(URLS)])
        fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        assert (row.host, row.path, row.rule, row.salt) == (host, path, best.name if best else None, "y")
        assert row.verdict == (best.verdict if best else row.verdict) and row.verdict in ("allow", "block")
        assert (row.score >= 0.5) == (row.verdict == "block") or best


def test_trees_learn_lexical_features_of_held_out_urls(spark):
    rng = random.Random(2)

    def url(bad):
        name = "".join(rng.choices("0123456789" if bad else "abcdefgh", k=8))
        query = "?a=1&b=2&c=3" if bad and rng.random() < 0.7 else ""
        return f"http://{name}.example.{rng.choice(['com', 'org'])}/{'x/' * rng.randrange(3)}{query}"

    bad = [rng.random() < 0.4 for _ in range(600)]
    rows = [(i, url(b) if i % 3 else url(b).replace(".example.", ".bad." if b else ".good."), b) for i, b in enumerate(bad)]
    pages = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    rules = [url_boost.Rule("block", "bad.com", ""), url_boost.Rule("block", "bad.org", "")]
    rules += [url_boost.Rule("allow", "good.com", ""), url_boost.Rule("allow", "good.org", "")]
    judged = url_boost.judge_urls(pages, rules).filter("rule IS NULL").collect()
    right = sum((r.verdict == "block") == r.bad for r in judged)
    assert len(judged) == 400 and right > 380


def test_suffix_statistics_leave_out_the_own_fold(spark):
    rows = [("x.com", "com", 0, 5, 5), ("x.com", "com", 1, 3, 0), ("y.com", "com", 1, 2, 2)]
    labelled = spark.createDataFrame(rows, "suffix string, top string, fold int, n long, ones long")
    statistics = url_boost.suffix_statistics(labelled)
    own = {(r.suffix, r.fold): (r.blocked, r.seen) for r in statistics.of_others["suffix"].collect()}
    assert own == {("x.com", 0): (0, 3), ("x.com", 1): (5, 5), ("y.com", 1): (0, 0)}
    assert {(r.top, r.fold): (r.blocked, r.seen) for r in statistics.of_others["top"].collect()} == {
        ("com", 0): (2, 5),
        ("com", 1): (5, 5),
    }
    assert {r.suffix: (r.blocked, r.seen) for r in statistics.tables["suffix"].collect()} == {"x.com": (5, 8), "y.com": (2, 2)}


def test_urls_without_labels_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.b/"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in url_boost.judge_urls(pages, RULES).collect()} <= {"allow", "block"}
    assert url_boost.judge_urls(pages.limit(0), RULES).collect() == []


@pytest.fixture(scope="module")
def marked(spark):
    """Every fifth document is toxic; a quarter of all have a label."""
    rows = []
    for i in range(800):
        toxic = i % 5 == 0
        text = prose(i, 60 + i % 90)
        words = text.split(" ")
        if toxic:
            words[i % 50] = random.Random(i).choice(["vile,", "foulness", "foulmouth"])
        rows.append((i, " ".join(words), toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic boolean")
    labels = docs.filter("doc_id % 8 < 3").select("doc_id", docs.toxic.cast("int").alias("toxic"))
    return docs, labels


def test_toxicity_of_held_out_documents(marked):
    docs, labels = marked
    model = toxicity.train(docs, labels.filter("doc_id % 7 <> 0"))
    scored = toxicity.score(docs, model).filter("doc_id % 7 = 0").collect()
    assert all(0 <= r.score <= 1 for r in scored)
    assert sum((r.score >= 0.5) == r.toxic for r in scored) > 0.95 * len(scored)


def test_toxicity_of_hostile_documents(spark, marked, hostile, empty):
    docs, labels = marked
    model = toxicity.train(docs, labels)
    scored = toxicity.score(hostile, model)
    assert scored.columns == [*hostile.columns, "score"] and scored.filter("score < 0.5").count() == hostile.count()
    assert toxicity.score(empty, model).collect() == []
    nothing = toxicity.train(hostile, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int"))
    assert toxicity.score(hostile, nothing).filter("score >= 0.5").count() == 0
    repeated = toxicity.train(docs.unionAll(hostile.select("doc_id", "text", (hostile.n > 5).alias("toxic"))), labels.unionAll(labels))
    assert toxicity.score(docs.filter("doc_id = 0"), repeated).first().score >= 0.5


def test_a_long_text_does_not_hide_a_toxic_word(marked, spark):
    docs, labels = marked
    model = toxicity.train(docs, labels)
    long = spark.createDataFrame([(1, prose(5, 30_000) + " vile " + prose(6, 30_000))], "doc_id long, text string")
    assert toxicity.score(long, model).first().score >= 0.5
