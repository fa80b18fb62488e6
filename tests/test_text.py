"""Scalar text functions against tables of inputs and outputs."""

import pytest
from pyspark.sql import functions as F

from sievebank.functions import regex, rules as R, text as t, titles as ti


def values(spark, rows, make):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, s string")
    return [r[0] for r in df.orderBy("k").select(make(F.col("s"))).collect()]


def test_boundaries_are_ascii(spark):
    assert values(spark, ["Go后端", "Gob", "go"], lambda s: regex.found(s, r"(?i)go\b")) == [True, False, True]
    assert values(spark, ["中", "a", "1"], lambda s: regex.found(s, r"[\p{Han}]")) == [True, False, False]


def test_labels(spark):
    rows = ["9、Go", "（3）Redis", "Q：RAG", "第 2 题：TCP", "3.14 版本", "1.", "普通", "10. 2 个"]
    assert values(spark, rows, t.strip_label) == ["Go", "Redis", "RAG", "TCP", "3.14 版本", "1.", "普通", "10. 2 个"]


def test_norm(spark):
    rows = ["介绍一下 GMP 模型", "介绍一下GMP模型", "什么是 RAG？", "  ", "——*"]
    assert values(spark, rows, t.norm) == ["gmp模型", "gmp模型", "rag", "", ""]


def test_normal_title(spark):
    assert values(spark, ["C++ 与 Go 的区别？", "。。。"], t.normal_title) == ["c与go的区别", ""]


def test_questions(spark):
    yes = ["介绍一下 GMP 模型", "进程和线程的区别", "手撕：LRU、二叉树层序遍历", "面试官问了什么问题？"]
    no = ["abc", "（备注）以上都是", "光速挂了，感谢信已收到", "面试官人很好，全程没怎么为难我", "内推码 ABC123，欢迎投递", "------", "4. HashMap", "return cache.get(key);"]
    assert all(values(spark, yes, t.is_question))
    assert not any(values(spark, no, t.is_question))


def test_modules_and_topics(spark):
    rows = ["手撕：LRU", "自我介绍", "为什么换工作", "你的项目难点", "agent 记忆", "MySQL 索引", "TCP 三次握手", "随便一个"]
    assert values(spark, rows, t.classify) == [R.ALGO, R.INTRO, R.HR, R.PROJECT, R.AGENT, R.BACKEND, R.CS, R.BACKEND]
    assert values(spark, ["MySQL 索引", "随便一个"], lambda s: t.topic_of(s, t.classify(s))) == ["数据库", "其他技术"]


def test_splits(spark):
    long = "你的项目里最大的难点是什么？怎么解决的？如果重来一次你会怎么设计这个系统的整体架构？还有别的想法吗"
    assert [len(x) for x in values(spark, [long, "一？二？", ""], t.split_inline)] == [4, 1, 1]
    assert values(spark, ["手撕：LRU、二叉树", "手写 快排 & 归并", "手撕 a、bc", "介绍 a、b"], t.split_compound) == [
        ["手撕：LRU", "手撕：二叉树"],
        ["手写：快排", "手写：归并"],
        ["手撕 a、bc"],
        ["介绍 a、b"],
    ]


def test_answers(spark):
    out = values(spark, ["- 正确答案：甲", "a\r\nb\n\n\n\nc", "x" * 3000], t.trim_answer)
    assert out[:2] == ["甲", "a\nb\n\nc"] and len(out[2]) == 2001 and out[2].endswith("…")
    assert values(spark, ["请提供更多信息", " ", "看起来您的输入不完整", "GMP 是"], t.is_meta_answer) == [True, True, True, False]


def test_cleaning(spark):
    assert values(spark, ['a<img src="x">b [doge]<b>c</b> &lt;x&gt; &amp;lt;'], t.clean_text) == ["ab c <x> &lt;"]
    assert values(spark, ["- [x] 介绍", "#字节# 问", "**粗**", "->甲　乙​"], t.strip_formatting)[:3] == ["介绍", "问", "粗"]
    assert values(spark, ["1. -> 甲　乙​", "🧑‍🤝‍🧑"], t.display_text) == ["甲 乙", "🧑‍🤝‍🧑"]


def test_helpers():
    assert [t.truthy(x) for x in ("1", "true", "", "0", "No", None)] == [True, True, False, False, False, False]
    assert (t.int_or(" 7 ", 1), t.int_or("x", 1), t.int_or(None, 3)) == (7, 1, 3)


@pytest.mark.parametrize(
    "title,expected",
    [
        ("字节跳动 后端开发 一面", ("字节跳动", "后端开发", "一面")),
        ("百度 大模型应用 终面", ("百度", "算法", "终面")),
        ("星河智能科技 后端 二面", ("星河智能科技", "后端", "二面")),
        ("今天面试了", ("", "", "")),
        ("miniMaxi 后端 一面", ("miniMaxi", "后端", "一面")),
        ("agent 后端 一面", ("", "后端", "一面")),
    ],
)
def test_titles(spark, title, expected):
    assert tuple(values(spark, [title], ti.parse_title)[0]) == expected


def test_rounds(spark):
    assert values(spark, ["一面\n略", "一面\n二面", "## 第二轮\nx", ""], ti.round_from_content) == ["一面", "", "二面", ""]
    assert values(spark, ["一面", "HR面", "笔试", "", "复活赛 一面"], ti.round_group) == ["一面", "HR 面", "三面及以上", "", "复活赛"]
    assert values(spark, ["Agent开发", "全栈", "C++", "golang", "测试"], ti.job_group) == ["Agent 开发", "全栈开发", "C++", "Go", "其他"]
    assert values(spark, ["我在 google 面试", "xgoogley"], lambda s: ti.company_in(s, ["google"])) == ["google", ""]


def test_rules_read_odd_lines_as_sql_does(spark):
    """RE2 ends a text at its end alone and knows the Kelvin sign as a k; Java does neither."""
    assert values(spark, ["数据库的事务隔离级别过了\r", "数据库的事务隔离级别过了", None], t.is_question) == [True, False, None]
    assert values(spark, ["K8s 调度策略", "k8s 调度策略"], lambda s: t.topic_of(s, t.classify(s))) == ["容器 / K8s"] * 2
