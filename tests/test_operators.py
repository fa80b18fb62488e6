"""Ingest, clustering, reposts, labels and maintenance."""

import random

from pyspark.sql import functions as F

from sievebank.operators import cluster, dedup, labels, leaders, maintenance
from sievebank.plans import text_queries
from sievebank.sources import pages, snapshot


def lines(spark, texts, official=()):
    rows = [(k, k, x, "c", "t", "答案：甲" if k in official else "", k in official) for k, x in enumerate(texts)]
    return spark.createDataFrame(rows, "post_id long, seq long, text string, cat string, topic string, answer string, official boolean")


def built(spark, texts, official=(), **more):
    out = cluster.build_questions(lines(spark, texts, official), **more)
    return {k: v.collect() for k, v in out.items()}


def greedy(keys, symmetric):
    found, of = [], {}
    bound = lambda n: n * 18 // 100

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    for k, key in enumerate(keys):
        for lead in found:
            a, n = keys[lead], max(len(keys[lead]), len(key))
            held = min(len(a), len(key)) >= 6 and n <= 2 * min(len(a), len(key)) and (a in key or key in a)
            near = (symmetric or abs(len(a) - len(key)) <= bound(len(key))) and distance(a, key) * 100 <= 18 * n
            if held or near:
                of[k] = lead
                break
        else:
            found.append(k)
            of[k] = k
    return of


def test_rounds_give_the_greedy_leaders(spark):
    r = random.Random(4)
    keys = []
    while len(keys) < 160:
        base = "".join(r.choice("abcd") for _ in range(r.randint(5, 22))) if r.random() < 0.4 or not keys else r.choice(keys)
        x = list(base)
        for _ in range(r.randint(0, 2)):
            x[r.randrange(len(x)) : 1] = r.choice(["", "e", "ab"])
        x = "".join(x)[:30]
        if x and x not in keys:
            keys.append(x)
    df = spark.createDataFrame(list(enumerate(keys)), "id long, key string")
    for symmetric in (False, True):
        led = {row.node: row.leader for row in leaders.followers(cluster.like_pairs(df, symmetric)).collect()}
        assert {k: led.get(k, k) for k in range(len(keys))} == greedy(keys, symmetric)


def test_official_text_names_the_cluster(spark):
    out = built(spark, ["介绍一下GMP模型", "介绍一下 GMP 模型", "TCP 三次握手过程"], official=(1,))
    first = out["questions"][0] if out["questions"][0].n == 2 else out["questions"][1]
    assert (first.canonical, first.n, first.answer) == ("介绍一下 GMP 模型", 2, "甲")
    assert len(out["occurrences"]) == 3 and [v.text for v in out["variants"]] == ["介绍一下GMP模型"]


def test_norms_are_unique_and_not_blank(spark):
    out = built(spark, ["————————", "*********", "介绍mysql", "-- MySQL --", "&和&&的区别", "==和===的区别"])
    norms = [x.norm for x in out["questions"]]
    assert len(set(norms)) == len(norms) and all(norms)


def test_later_key_alone_bounds_the_length(spark):
    texts = ["aXbcdefYghij", "abcdefghij"]
    assert len(built(spark, texts)["questions"]) == 2
    assert len(built(spark, texts, symmetric=True)["questions"]) == 1


def test_growing_prefixes_do_not_swallow_all(spark):
    whole = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    assert len(built(spark, [whole[: 7 * 2**k] for k in range(3)] + [whole])["questions"]) > 1


def test_merges_and_groups(spark):
    assert cluster.resolved_merges([("甲", "乙"), ("乙", "丙"), ("丁", "丁")]) == {"甲": "丙", "乙": "丙"}
    merges = spark.createDataFrame([("请做自我", "自我", "自我介绍一下")], "src string, dst string, rep string")
    out = built(spark, ["请做一下自我介绍", "自我介绍一下", "别的问题一个"], merges=merges)
    assert sorted((q.canonical, q.n) for q in out["questions"]) == [("别的问题一个", 1), ("自我介绍一下", 2)]
    groups = spark.createDataFrame([("什么是React框架", "1", "React"), ("什么是ReAct框架", "2", "ReAct")], "member string, grp string, title string")
    out = built(spark, ["什么是React框架", "什么是ReAct框架"], groups=groups)
    # both titles have one normal form: the later cluster takes its member's wording
    assert sorted((q.canonical, q.norm) for q in out["questions"]) == [("React", "react"), ("什么是ReAct框架", "react框架")]


def reposts(spark, rows):
    sets = spark.createDataFrame([(i, q) for i, _, qs in rows for q in qs], "post_id long, question_id long")
    titles = spark.createDataFrame([(i, t) for i, t, _ in rows], "post_id long, title string")
    return sorted(r.id for r in dedup.duplicate_posts(sets, titles).collect())


def test_reposts(spark):
    five = [10, 11, 12, 13, 14]
    assert reposts(spark, [(1, "t", five), (2, "t", five), (3, "t", five[:4]), (4, "t", [10, 11, 12, 98, 99]), (5, "u", five)]) == [2, 3]
    assert reposts(spark, [(1, "t", five), (2, "t", [1, 2, 3])]) == []
    assert reposts(spark, [(1, "", five), (2, "", five)]) == []
    many = list(range(25))
    assert reposts(spark, [(1, "a", many), (2, "b", many), (3, "c", many)]) == [2, 3]
    assert reposts(spark, [(1, "a", five[:4]), (2, "b", five[:4])]) == []
    assert reposts(spark, [(1, "a", range(20)), (2, "b", [*range(18), 50, 51])]) == []


def state(content, more=""):
    return '<html><script>window.__INITIAL_STATE__={"prefetchData":{"2":{"ssrCommonData":{"contentData":%s%s}}}};</script></html>' % (content, more)


def test_pages(spark):
    rows = [
        (1, "https://example.org/discuss/918260041663119360?x=1", state('{"id":918260041663119360,"uuid":"ab","title":"字节跳动 后端开发 一面","content":"if (x) { return \\"};\\"; }<br>介绍 GMP","createTime":0,"editTime":5}')),
        (2, "u", state("{}")),
        (3, "u", "<html>nothing</html>"),
        (4, "u", "window.__INITIAL_STATE__=[1]"),
        (5, "u", 'window.__INITIAL_STATE__={"a":1'),
        (6, "u", state('{"id":7,"title":"招聘启事","content":"内推码 投递链接"}')),
    ]
    df = spark.createDataFrame(rows, snapshot.PAGES)
    flags = [r[0] for r in df.orderBy("page_id").select(pages.is_content_page(F.col("html"))).collect()]
    assert flags == [True, False, False, False, False, True]
    (post,) = pages.posts_of(df).collect()
    assert (post.id, post.url, post.company, post.round, post.posted_at) == (918260041663119360, "https://example.org/discuss/918260041663119360", "字节跳动", "一面", 5)
    assert "介绍 GMP" in post.content.split("\n")


def test_upsert_keeps_sticky_columns(spark):
    old = spark.createDataFrame([(1, "an author", "a"), (2, "b", "b")], "id long, author_name string, title string")
    new = spark.createDataFrame([(1, "", "c"), (3, "", "d")], "id long, author_name string, title string")
    out = sorted(tuple(r) for r in maintenance.upsert(old, new, "id", ("author_name",)).collect())
    assert out == [(1, "an author", "c"), (2, "b", "b"), (3, "", "d")]


def test_labels(spark):
    q = spark.createDataFrame([(1, "甲"), (2, "乙"), (3, "丙")], "id long, norm string")
    lab = spark.createDataFrame([("甲", "分类A"), ("乙", "不存在"), ("丁", "分类A")], "norm string, cat string")
    tax = spark.createDataFrame([("分类A", "域A", "合并A")], "name string, domain string, merged string")
    out = sorted((r.id, r.llm_cat, r.llm_merged) for r in labels.labeled(q, lab, tax).collect())
    assert out == [(1, "分类A", "合并A"), (2, "", ""), (3, "", "")]
    assert sorted(tuple(r) for r in labels.merged_labels(lab, lab.limit(1).withColumn("cat", F.lit("新"))).collect())[0][0] in ("丁", "乙", "甲")


def test_shards_are_a_partition(spark):
    urls = spark.range(3000).select(F.concat(F.lit("https://example.org/discuss/"), "id").alias("url"))
    counts = [r["count"] for r in urls.groupBy(snapshot.shard_of(F.col("url"), 3)).count().collect()]
    assert len(counts) == 3 and sum(counts) == 3000 and min(counts) >= 500


def test_files(spark, tmp_path):
    p = tmp_path / "posts.jsonl"
    p.write_text('{"id":1,"uuid":"a","title":"t","createdAt":5}\nbroken\n{"id":2,"createdAt":5}\n')
    assert [r.id for r in snapshot.jsonl_posts(spark, str(p)).collect()] == [1]
    m = tmp_path / "sitemap.txt"
    m.write_text("<loc>https://example.org/discuss/2?x=1</loc>\nhttps://example.org/discuss/1\nhttps://example.org/discuss/1")
    assert [r.url for r in snapshot.sitemap(spark, [str(m)], "https://example.org").collect()] == ["https://example.org/discuss/1", "https://example.org/discuss/2"]
    t = tmp_path / "taxonomy.json"
    t.write_text('{"domains":[{"name":"d","categories":[{"name":"c","desc":"x"}]}],"unclassified":{"name":"非题目","desc":"","count":1}}')
    assert [(r.name, r.domain, r.sort_order) for r in labels.taxonomy_of(spark, str(t)).orderBy("sort_order").collect()] == [("c", "d", 0), ("非题目", "非知识点", 1)]
    import gzip

    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "0123456789abcdef0123.html.gz").write_bytes(gzip.compress("<html>页</html>".encode()))
    assert [tuple(r) for r in snapshot.gzip_pages(spark, str(tmp_path / "raw")).collect()] == [("0123456789abcdef0123", "<html>页</html>")]
    assert snapshot.next_batch(spark, str(tmp_path / "out")) == 0
    snapshot.write_batches(maintenance.batched(spark.range(7), [F.col("id")], 3, 4), str(tmp_path / "out"))
    assert snapshot.next_batch(spark, str(tmp_path / "none"), str(tmp_path / "out")) == 7
    version = snapshot.write_snapshot({"a": spark.range(3)}, str(tmp_path / "bank"))
    assert snapshot.read_snapshot(spark, version, "a")["a"].count() == 3


def test_stream(spark, tmp_path):
    from sievebank.streaming.ingest import follow_posts, page_stream

    html = state('{"id":5,"uuid":"ab","title":"字节跳动 后端开发 一面","content":"x"}')
    spark.createDataFrame([(1, "https://example.org/discuss/5", html)], snapshot.PAGES).write.parquet(str(tmp_path / "pages"))
    versions = []

    def replace(df):
        path = str(tmp_path / f"posts-{len(versions)}")
        df.write.parquet(path)
        versions.append(path)

    query = follow_posts(page_stream(spark, str(tmp_path / "pages")), str(tmp_path / "check"), lambda: spark.read.parquet(versions[-1]) if versions else None, replace)
    query.awaitTermination(120)
    assert [r.id for r in spark.read.parquet(versions[-1]).collect()] == [5]


def test_registered_reposts_equal_brute_force(spark, tmp_path):
    long = "some long first line " * 15
    lines = lambda a, b: [f"line {k}" for k in range(a, b)]
    docs = [[long + "one", *lines(0, 10)], [long + "two", *lines(0, 10)], [long + "one", *lines(0, 9)], ["short", *lines(20, 40)], ["Short!", *lines(20, 40)], ["other", *lines(20, 40)], ["", *lines(50, 55)], ["", *lines(50, 55)]]
    rows = [(k, "\n".join(x)) for k, x in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sets = {k: {x for x in d if x} for k, d in enumerate(docs)}
    titles = {k: "".join(c for c in d[0].lower() if c.isalnum()) for k, d in enumerate(docs)}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    gone = set()
    for same in (True, False):
        kept = []
        for k in sorted(sets.keys() - gone):
            fits = (lambda j: titles[j] == titles[k] != "" and alike(j, k) >= 0.8) if same else (lambda j: min(len(sets[j]), len(sets[k])) >= 8 and alike(j, k) >= 0.9)
            gone.add(k) if any(map(fits, kept)) else kept.append(k)
    assert gone == {2, 4, 5}
    assert {r.id for r in text_queries.QUERIES["reposts"][0](spark, str(tmp_path)).collect()} == gone


def test_companies_by_join_equal_the_list(spark):
    from sievebank.functions import titles

    names = ["字节", "字节跳动", "Go", "GoPro", "腾讯", "网易有道"] + [f"company{k}" for k in range(6000)]
    texts = ["字节跳动 后端 一面", "going to GoPro", "Go 一面", "algo 腾讯", "company17 二面", "company170 x", "xcompany5", "", "无"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "key long, title string")
    joined = {r.key: r.known for r in titles.known_companies(df, spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    listed = {r.key: r.c for r in df.select("key", titles.company_in(F.col("title"), names).alias("c")).collect()}
    want = ["字节跳动", "GoPro", "Go", "腾讯", "company17", "company170", "", "", ""]
    assert [listed[k] for k in range(9)] == want
    assert [joined.get(k, "") for k in range(9)] == want


def test_norms_of_clusters_are_unique(spark):
    from sievebank.operators import cluster

    clusters = spark.createDataFrame([(1, "Redis", "redis"), (2, "Redis!", "redis"), (3, "redis2", "redis2"), (4, "REDIS?", "redis"), (5, "redis.", "redis")], "cluster long, canonical string, norm string")
    members = spark.createDataFrame([(1, "Redis", 0), (2, "Redis!", 1), (2, "Redis 缓存", 2), (3, "redis2", 3), (4, "REDIS?", 4), (5, "redis.", 5)], "cluster long, text string, number long")
    got = {r.cluster: (r.canonical, r.norm) for r in cluster.with_unique_norms(clusters, members).collect()}
    assert got[1] == ("Redis", "redis") and got[3] == ("redis2", "redis2") and got[2] == ("Redis 缓存", "redis缓存")
    assert len({n for _, n in got.values()}) == 5 and got[4] == ("REDIS?", "redis23") and got[5] == ("redis.", "redis234")


def test_strata_are_topped_up(spark):
    rows = spark.createDataFrame([(k, "a" if k < 3 else "b") for k in range(50)], "id long, cat string")
    got = maintenance.stratified(rows, "cat", "id", 20).collect()
    assert len(got) == 20 and len({r.id for r in got}) == 20 and sum(r.cat == "a" for r in got) == 3
    assert len(maintenance.stratified(rows, "cat", "id", 90).collect()) == 50


def test_readers_of_rules(spark, tmp_path):
    from sievebank.operators import cluster

    (tmp_path / "merges.json").write_text('[{"from":"Cache A","to":"cache-b"},{"from":"cache B","to":"Cache C!"},{"from":"","to":"x"}]')
    rows = {r.src: (r.dst, r.rep) for r in cluster.read_merges(spark, str(tmp_path / "merges.json")).collect()}
    assert rows == {"cachea": ("cachec", "Cache C!"), "cacheb": ("cachec", "Cache C!")}
    (tmp_path / "groups.json").write_text('{"groups":[{"canonical":"1. React 是什么","members":["React?","react 原理",""]}]}')
    groups = cluster.read_groups(spark, str(tmp_path / "groups.json")).collect()
    assert sorted((r.member, r.title) for r in groups) == [("React?", "React 是什么"), ("react 原理", "React 是什么")]
    assert cluster.read_groups(spark, str(tmp_path / "groups.json")).columns == ["member", "grp", "title"]


def test_rebuild_and_its_snapshot(spark, tmp_path):
    import json

    from sievebank.operators import rebuild as rb

    def page(k, title, content):
        state = {"prefetchData": {"2": {"ssrCommonData": {"contentData": {"uuid": f"u{k}", "id": k, "title": title, "content": content, "createdAt": 1_700_000_000_000 + k}}}}}
        return (k, f"https://example.org/feed/main/detail/u{k}", f"<html><script>window.__INITIAL_STATE__={json.dumps(state)};</script></html>")

    rows = [page(1, "星海科技 后端开发 一面", "1. Redis 为什么快？<br>2. 说一下 MySQL 的索引"), page(2, "星海科技 后端 二面 面经", "1. Redis 为什么快<br>2. Kafka 如何保证&hellip;不丢消息？"), (3, "https://example.org/x", "<html>shell</html>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    names = spark.createDataFrame([("星海科技",)], "name string")
    out = rb.rebuild(pages, names, "https://example.org", folder=str(tmp_path / "bank"))
    posts = {r.id: r.company for r in out["posts"].collect()}
    assert posts == {1: "星海科技", 2: "星海科技"}
    questions = {r.canonical: (r.n, r.co_n) for r in out["questions"].collect()}
    assert any("Redis" in c and v == (2, 1) for c, v in questions.items()) and not any("&hellip" in c for c in questions)
    assert snapshot.current(spark, str(tmp_path / "bank"), "questions")["questions"].count() == len(questions)
    again = rb.rebuild(pages.limit(0), names, "https://example.org", old_posts=out["posts"], folder=str(tmp_path / "bank"))
    assert {r.canonical for r in again["questions"].collect()} == set(questions)
    manifest = spark.createDataFrame([("a", rows[0][1], 200, 5, 1), ("b", rows[2][1], 200, 5, 1), ("c", "https://example.org/gone", 200, 5, 1)], snapshot.MANIFEST)
    assert [r.hash for r in rb.checked(manifest, pages).collect()] == ["a"]


def like(a, b, symmetric):
    """Whether the later key ``b`` is like ``a``."""
    return greedy([a, b], symmetric)[1] == 0


def test_large_blocks_give_each_pair_once(spark, monkeypatch):
    r = random.Random(7)
    names = {f"supplier{k:06d}" for k in range(60)} | {f"supplier{k:06d}" for k in range(0, 990_000, 16_500)}
    names |= {x[: r.randint(9, 13)] for x in r.sample(sorted(names), 12)} | {x + r.choice(["7", "ab"]) for x in r.sample(sorted(names), 12)}
    long = "".join(r.choice("abcdefgh") for _ in range(90))
    keys = sorted(names) + [long, long[:40] + "z" + long[40:], long[5:]]
    r.shuffle(keys)
    df = spark.createDataFrame(list(enumerate(keys)), "id long, key string")
    monkeypatch.setattr(cluster, "TILE", 16)
    for symmetric in (False, True):
        want = sorted((i, j, keys[i], keys[j]) for j in range(len(keys)) for i in range(j) if like(keys[i], keys[j], symmetric))
        assert sorted(tuple(x) for x in cluster.like_keys(df, symmetric, large=100).collect()) == want


def test_leaders_of_many_alike_keys_come_from_portions(spark, monkeypatch):
    r = random.Random(9)
    keys = list({f"supplier{k:06d}" for k in r.sample(range(60_000), 150)}) + ["", "abc", "abcdefg", "xabcdefgx", "einzeln stehend", "ganz anderer text"]
    keys += [x[: r.randint(9, 13)] for x in keys[:20]]
    keys = list(dict.fromkeys(keys))
    r.shuffle(keys)
    df = spark.createDataFrame([*enumerate(keys), (len(keys), None)], "id long, key string")
    asked = []
    pairs = cluster.like_pairs
    monkeypatch.setattr(cluster, "like_pairs", lambda keys, *more: asked.append(keys.count()) or pairs(keys, *more))
    for symmetric in (False, True):
        for portion in (4096, 64):
            asked.clear()
            led = {row.node: row.leader for row in cluster.like_followers(df, symmetric, portion).collect()}
            assert {k: led.get(k, k) for k in range(len(keys))} == greedy(keys, symmetric)
            assert portion == 64 or not asked  # one scan, no pairs
    few = [f"{k:03d}" * 5 + "".join(r.choice("abcdefghij") for _ in range(20)) for k in range(90)]
    few += [x[:-1] + "z" for x in few[:20]]
    led = {row.node: row.leader for row in cluster.like_followers(spark.createDataFrame(list(enumerate(few)), "id long, key string"), False, 32).collect()}
    assert {k: led.get(k, k) for k in range(len(few))} == greedy(few, False) and asked[-1] == len(few)


def test_similar_pairs_by_combinations(spark, monkeypatch):
    from pyspark.sql import functions as F

    r = random.Random(3)
    sets = {k: set(r.sample(range(24), r.choice([1, 2, 3, 4, 5, 6, 8, 11, 17]))) for k in range(110)}
    for k in range(110, 150):
        sets[k] = set(sets[k - 90]) ^ set(r.sample(range(24), 2))
    rows = [(k, q) for k, own in sets.items() for q in own]
    df = spark.createDataFrame(rows, "post_id long, question_id long")
    for threshold, least in ((0.5, 2), (0.8, 1)):
        near = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and min(len(sets[a]), len(sets[b])) >= least}
        want = {k: v for k, v in near.items() if v >= threshold}
        for small in (0, 6, 15, 16):
            got = dedup.similar_pairs(df, F.lit(True), threshold, least, small=small).collect()
            assert len(got) == len(want) and {(x.a, x.b): x.jaccard for x in got} == want
