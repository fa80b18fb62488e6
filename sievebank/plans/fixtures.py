"""Lines, titles and pages of the domain, for queries whose rules the driver's tables never meet."""

LINES = (
    "介绍一下 GMP 模型", "介绍一下GMP模型", "1. 讲讲 MySQL 的索引结构", "（3）Redis 为什么快？", "Q：什么是 RAG？", "9、Go 的 slice 和数组有什么区别",
    "3.14 版本的新特性是什么", "第 2 题：TCP 三次握手的过程", "手撕：LRU、二叉树层序遍历", "手写 快排 & 归并", "实现一个 阻塞队列 以及 令牌桶", "面试官人很好，全程没怎么为难我",
    "光速挂了，感谢信已收到", "一共问了半小时，深挖项目", "内推码 ABC123，欢迎投递", "有什么想问我的吗？", "自我介绍", "请做一下自我介绍",
    "你的项目里最大的难点是什么？怎么解决的？如果重来一次你会怎么设计这个系统的架构？", "讲一下 agent 的记忆机制", "k8s 的 pod 调度流程", "为什么换工作？", "期望薪资是多少",
    "进程和线程的区别", "epoll 和 select 的区别", "- [ ] 介绍 Kafka 的高可用", "**说说 JVM 垃圾回收**", "#字节面经# 一面凉了", "https://a.com/x?y=1 这个题怎么做", "return cache.get(key);",
    "备注：以上为回忆版", "4. HashMap", "鼠鼠我已经面了三家公司了，今年秋招真的太难了，感觉没有希望了", "算法题：两数之和", "base 地在哪里", "大模型幻觉怎么缓解", "协程调度 go 语言", "-> Embedding 是什么",
    "字节跳动 后端开发 一面", "   ", "abc", "系统设计：短链服务，如何保证高可用与幂等", "C++ 虚函数表的原理", "http 和 https 的区别",
)
TITLES = (
    "字节跳动 后端开发 一面", "腾讯 测试开发 HR面", "美团暑期实习 二面 面经", "某公司 算法 三面", "百度 大模型应用 终面", "minimax Agent开发 一面", "miniMaxi 后端 一面", "小红书Java后端一面凉经", "今天面试了", "华为笔试",
    "阿里 复活赛 一面", "27届校招内推开始啦", "星河智能科技 后端 二面", "2026星河 golang 一面", "群面分享", "google sre 三面",
)
CONTENTS = ("一面\n1. 介绍 GMP\n2. 手撕 LRU", "## 第二轮\n问题", "一面：\n略\n二面：\n略", "HR面\n期望薪资", "没有标题的正文，讲了很多很多很多很多很多很多很多内容", "")


def values_sql(rows: tuple[str, ...], name: str = "s") -> str:
    own = ", ".join("('" + r.replace("'", "''") + "')" for r in rows)
    return f"SELECT * FROM (VALUES {own}) AS v({name})"
