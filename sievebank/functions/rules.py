"""Rule tables of the text functions.

All of these are fixed values: results depend on them as they stand, and ordered tables on
their order.  Patterns are in RE2 syntax; ``regex.java`` translates them.
"""

# Cleaning.
IMAGE = r"<img[^>]*>"
CARD = r'data-card-emoji="[^"]*"'
EMOJI = r"\[[^\]]{1,6}\]"
TAG = r"<[^>]+>"
LINES = r"[\n\r]+"
MARKDOWN = r"^\s*(?:[-*•]\s+|\[\s*[xX ]?\s*\]\s*)+"
TAGS_IN_FRONT = r"^(?:#[^#\s]{1,24}#?\s*)+"
BOLD = r"\*\*"
NON_WORD = r"[^\p{L}\p{N}]+"
ARROW = r"^(?:->|→|•|·)\s*"
LABELS = (
    r"^\s*\d{1,2}\s*[.、)．]\s*",
    r"^\s*[（(]\s*\d{1,2}\s*[)）]\s*",
    r"^\s*第\s*\d{1,2}\s*[题问]\s*[:：]?\s*",
    r"^\s*(?:面试问题|面试题|问题|题目|Q|q)\s*[:：]\s*",
)
FILLERS = (
    "你们", "我们", "你", "一下", "怎么", "如何", "什么是", "什么", "哪些", "为什么", "吗", "呢",
    "请问", "讲讲", "讲一下", "说说", "介绍", "大概", "主要", "具体", "的", "了",
)

# What is no question.
STRONG_REMARK = r"(光速|半小时|已挂|挂了|凉了|感谢信|收到offer|口头offer|等通知|面完|测评挂|进池子|排序中|无hc|结果通知|已oc)"
META_REMARK = r"^(leader面|面试官|整体|全程|总共|一共|感觉|大概|差不多|项目挨着|深挖|问的挺|聊了)"
COMPLAINT = r"(面试官.{0,8}(装|pua|PUA|不懂|水)|有点装|太装|亏麻|无语|离谱|不会面|这种了|属于是|西装革履|光速搞定|拷打|真给挂|浪费时间|一直被挑战|也不好进|不好进|hhh|233|kpi面|KPI面|难绷|骗分|骗分了|光暴力)"
OUTCOME = r"^(过了|已过|通过了|已约|约二面|约三面|等二面|等三面|等通知|进二面|进三面|出结果|预估.{0,8}结果|给挂了|真给挂|面完了|已offer|面了\d+)"
OUTCOME_AT_END = r"(过了|挂了|凉了|通过了|结束了)$"
ASKING = r"[？?]|^(请问|你(们)?|怎么|如何|什么|为什么|哪些|介绍|讲|说|手撕|手写)"
NARRATIVE = r"[。.]$"
POST_TITLE = r"^\S{2,20}\s+\S{2,20}\s+(一面|二面|三面|四面|终面|hr面|HR面|笔试|机试)$"
SOLICIT = r"点个赞|求赞|点赞收藏|评论区可以问|评论区交流|欢迎交流|看到都会回|关注我|码字不易|整理不易"
HAS_WORD = r"[\p{Han}A-Za-z0-9]"
RECRUIT_LINE = r"内推码|内推|招聘|校招启动|投递链接|扫码|简历投递|base地|福利待遇"
TAG_LINE = r"^#|#[^#]{1,20}#"
TEACHING = r"面试官(想听|希望|期待|会|往往|可能)|面试时|面试中|回答这类|候选人(应该|可以|要)"
GUIDE = r"第[一二三四五六七八九十]步|第[一二三四五]遍|第一步|总结一下|划重点|小技巧|必刷|复习计划"
JOB_PROCESS = r"秋招|春招|校招|社招|实习|笔试|投递|简历|offer|Offer|OFFER|去年|今年|昨天|今天|上周|这周"
HAS_URL = r"https?://|www\.\S|\.com/|\.cn/"
URL = r"https?://\S+|www\.\S+"
CODE_WORD = r"\b(int|void|return|class|struct|public|private|static|func|var|const)\b"
NOTE = r"^\s*(备注|注|说明|提示)\s*[:：]"
SHORT_NUMBERED = r"^\s*\d{1,2}\s*[、.．]\s*[A-Za-z0-9_\-./]{1,8}$"
SELF = r"我|自己|本人|感觉|觉得"
QUESTION_PHRASE = r"什么|怎么|如何|为什么|哪些|是否|有没有|是不是|区别|介绍|讲讲|说说|手撕|手写"
CODE = r"->|=>|\.\w+\("
FIRST_PERSON = r"鼠鼠|本鼠|我已经|我现在|我当时|我后来|后来我|然后我|其实我|我感觉|我觉得|我投了|我做了|我面了|我笔试"

# Modules.
ALGO, CS, BACKEND, AGENT, PROJECT, INTRO, HR = "算法", "计算机基础", "后端工程", "Agent/AI", "项目", "开场/通用", "HR/软性"
ALGO_START = r"^(手撕|手写|写一个|实现一个(?:函数|算法)|算法题|编程题)"
ALGO_NAME = r"\bLRU\b|链表去重|二叉树|动态规划|全排列|三数之和|接雨水|大数相加|中位数|公共祖先|最小栈|令牌桶|阻塞队列|无锁队列|层序遍历|所有子集|平方根|区间合并|有环|深拷贝|回文|岛屿数量|岛屿最大|股票买卖|两数之和|数组的交集|正方形判定|中缀转后缀|快排|归并"
ALGO_REMARK = r"花了|想不起来|难崩|不让用"
MODULES = (
    (INTRO, r"自我介绍|介绍一下自己|介绍(一下)?你自己|简单介绍(一下)?你|先介绍(一下)?你|介绍一下你(的)?(情况|背景|经历|工作)|你们组|你们团队|你们部门|组里做|团队(做|在)(什么|啥)|有什么想问|你想问|还有什么问题|反问"),
    (HR, r"离职|为什么换|换工作|跳槽|动机|看机会|为什么看|薪资|总包|待遇|绩效|职级|晋升|职业规划|未来.{0,6}规划|\bbase\b|base地|地点|老家|offer|诉求|自我评价|优缺点|最有成就|你觉得自己|期望|到岗|你的规划|家庭|结婚|年龄|个人发展|技术规划|转岗|倾向"),
    (PROJECT, r"你的项目|你们(的)?项目|你们(现在|这套|这个|内部)|项目.{0,8}(介绍|讲|难点|挑战|深挖|架构|价值)|介绍.{0,4}项目|讲.{0,4}项目|项目经历|你负责|你的角色|你做过|重构|提效|交付|归因|(?i)ab\s*测试|埋点|灰度|风险|回滚|上线|落地|业务|工作内容|赋能|核心.{0,4}工作|部门|方案|产品|标准化"),
    (AGENT, r"(?i)agent|harness|智能体|\bmcp\b|skill|技能|上下文|记忆|memory|rag|知识库|检索|llm|大模型|幻觉|微调|后训练|推理|prompt|token|沙箱|sandbox|越权|multi-?agent|agent\s*team|workflow|工作流|工具调用|向量|embedding|评测|eval|claude\s?code|codex|cursor|copilot|codebuddy|superpower|openspec|\bsdd\b|\btdd\b|ai\s*coding|ai原生|编码工具|调用模型|流式|stream"),
    (BACKEND, r"(?i)\bgo\b|golang|\bgmp\b|goroutine|channel|\bslice\b|defer|\bgc\b|\bmap\b|java|jvm|python|装饰器|c\+\+|cpp|闭包|泛型|多态|指针|mysql|索引|事务|分库|分表|postgres|\bpg\b|mongo|sqlite|数据库|存储引擎|redis|缓存|kafka|\bmq\b|消息队列|zookeeper|etcd|k8s|kubernetes|docker|容器|镜像|\bpod\b|ingress|kubectl|helm|架构|微服务|\bddd\b|高可用|分布式|中台|解耦|限流|熔断|降级|幂等|系统设计|性能|优化|延迟|\bqps\b|吞吐|并发|压力测试|grpc|trpc|\brpc\b|restful"),
    (CS, r"操作系统|计算机基础|组成原理|编译原理|词法分析|语法分析|文法|有限状态机|进程|线程|协程|死锁|内存管理|虚拟内存|页面置换|用户态|内核态|上下文切换|多路复用|epoll|select|文件系统|中断|(?i)\btcp\b|\budp\b|\bhttp\b|\bhttps\b|\bdns\b|三次握手|四次挥手|网络分层|\bosi\b|socket|拥塞|滑动窗口|keep-?alive|反向代理|子网|网关"),
)

# Topics within a module.
FIXED_TOPICS = ((ALGO, "算法/手撕"), (PROJECT, "项目深挖"), (INTRO, INTRO), (HR, "HR/动机"))
OTHER_TOPIC = "其他技术"
TOPICS = {
    CS: (
        ("操作系统", r"进程|线程|协程|死锁|内存管理|虚拟内存|页面置换|用户态|内核态|上下文切换|多路复用|epoll|select|文件系统|中断|锁"),
        ("计算机网络", r"(?i)\btcp\b|\budp\b|\bhttp\b|\bhttps\b|\bdns\b|握手|挥手|网络分层|\bosi\b|socket|拥塞|滑动窗口|keep-?alive|反向代理|子网|网关"),
    ),
    BACKEND: (
        ("语言特性", r"(?i)\bgo\b|golang|\bgmp\b|goroutine|channel|\bslice\b|defer|\bgc\b|\bmap\b|java|jvm|python|装饰器|c\+\+|cpp|闭包|泛型|多态|指针"),
        ("数据库", r"(?i)mysql|索引|事务|分库|分表|postgres|\bpg\b|mongo|sqlite|数据库|存储引擎"),
        ("缓存 / 中间件", r"(?i)redis|缓存|kafka|\bmq\b|消息队列|zookeeper|etcd"),
        ("容器 / K8s", r"(?i)k8s|kubernetes|docker|容器|镜像|\bpod\b|ingress|kubectl|helm"),
        ("架构 / 系统设计", r"架构|微服务|\bddd\b|高可用|分布式|中台|解耦|限流|熔断|降级|幂等|系统设计|重构"),
        ("性能优化", r"性能|优化|延迟|\bqps\b|吞吐|并发|压力测试"),
        ("RPC / 协议", r"(?i)grpc|trpc|\brpc\b|restful|协议"),
        ("工程实践", r"(?i)研发效能|\bci\b|\bcd\b|ci/?cd|测试|单测|回归|code\s?review|代码审查|开源|二开|分叉|上线流程|发布流程|监控|告警|运维|landing|灰度|值班|事故|复盘"),
        ("前端 / 客户端", r"(?i)vue|react|前端|浏览器|页面|css|javascript|\bjs\b|webpack|小程序|安卓|android|\bios\b|客户端|\bsdk\b|flutter|rn\b|鸿蒙|harmony"),
        ("C / C++", r"(?i)c\+\+|cpp|shared_ptr|unique_ptr|智能指针|虚函数|左值|右值|移动语义|模板|\bstl\b|\braii\b|构造函数|析构|内存泄漏|指针|mcu\b|嵌入式|\brtos\b|\bcan\b|寄存器|中断服务"),
        ("Java / JVM", r"(?i)\bjava\b|\bjvm\b|\bjdk\b|spring|netty|\bbean\b|\baop\b|\bioc\b|垃圾回收器|类加载|线程池|synchronized|\bvolatile\b|hashmap|concurrenthashmap"),
    ),
    AGENT: (
        ("MCP / Skill", r"(?i)\bmcp\b|skill|技能"),
        ("上下文 / 记忆", r"(?i)上下文|记忆|memory|context"),
        ("RAG / 知识库", r"(?i)rag|知识库|检索|向量|embedding"),
        ("Multi-Agent", r"(?i)multi-?agent|agent\s*team|协作|多个agent|多智能体"),
        ("AI 编码工具", r"(?i)codex|claude\s?code|cursor|codebuddy|copilot|superpower|openspec|sdd|\btdd\b|ai\s*coding|编码工具|\bcli\b|\bide\b"),
        ("Agent 架构 / Harness", r"(?i)agent|harness|智能体|工作流|workflow|工具调用|规划"),
        ("LLM / 大模型", r"(?i)llm|大模型|幻觉|微调|后训练|推理|prompt|token|评测|eval"),
        ("沙箱 / 权限", r"沙箱|sandbox|越权|权限|隔离"),
        ("推荐 / 搜索", r"推荐|召回|排序|\bctr\b|\bcvr\b|特征工程|冷启动|长尾|搜索|\b粗排\b|\b精排\b|用户画像"),
        ("训练 / 微调", r"微调|\bsft\b|\bdpo\b|\bppo\b|\bgrpo\b|预训练|蒸馏|量化|分布式训练|\blora\b|强化学习|奖励模型|\brlhf\b"),
    ),
}

# Answers.
ANSWER_PREFIX = r"^\s*[-•·]?\s*(正确答案|参考答案|答案)\s*[:：]\s*"
META_ANSWER = r"^\s*(请提供|请补充|请说明|看起来您的输入|您是想了解|你的输出是|我的输出是|(我?作为|我是)一?个?\s*(AI|人工智能|语言模型|面试官)|我无法回答|抱歉[，,]?我)"
META_ANSWER_NEAR = r"看起来您的输入|您是想了解|请提供(具体|您希望)的"
ANSWER_CAP = 2000

# Compound lines.
ALGO_LEAD = r"^\s*(手撕|手写|写一个|实现一个)[：:、\s]*"
COMPOUND = r"\s*(?:&|＆|以及|加上)\s*"
COMMAS = r"\s*[、,，]\s*"

# Posts.
INTERVIEW_TITLE = r"面经|面试|笔试|机试|测评|一面|二面|三面|四面|终面|初面|复试|群面|主管面|交叉面|HR面|hr面"
TOPIC_LINK = r'<a href="/creation/subject/[0-9a-f]+"[^>]*>([^<]{1,40})</a>'
BREAKS = r"(?i)<br\s*/?>|</p>|</div>"
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))
INTERVIEW_WORD = r"面经|面试|一面|二面|三面|四面|终面|初面|复试|群面|交叉面|主管面|技术面|HR面|hr面|笔试|机试|秋招|春招|校招|社招|实习|offer|Offer|OFFER|意向书|开奖|泡池子"
EXCLUDED_TITLE = r"^题解|^【?题解|^内推$|^招聘|^岗位汇总|^面经汇总$|^资料|^面经模板"
AD_WORD = r"内推|内推码|招聘详情|热招岗位|职类|投递CD|简历直给|扫码投递|帮你内推|可内推|内推群|招聘启事|网申|宣讲会|投递链接|简历优先筛选|锁定[Oo]ffer|招聘对象|热招|投递传送门|传送门"
INTERVIEW_SIGNAL = r"面经|面试|一面|二面|三面|四面|面试官|八股|手撕|自我介绍|反问"

# Titles.
STRICT_TITLE = r"^(.+?)\s+(.+?)\s+(一面|二面|三面|四面|hr面|HR面|复活赛 一面|复活赛 二面)$"
ROUNDS = (
    ("复活赛 一面", r"复活赛\s*一面"),
    ("复活赛 二面", r"复活赛\s*二面"),
    ("HR面", r"(?i)\bHR\s*面|hr面|人力面"),
    ("群面", r"群面"),
    ("主管面", r"主管面"),
    ("交叉面", r"交叉面"),
    ("终面", r"终面"),
    ("初面", r"初面"),
    ("四面", r"四面"),
    ("三面", r"三面"),
    ("二面", r"二面"),
    ("一面", r"一面"),
    ("笔试", r"笔试|机试|在线编程|编程题"),
    ("测评", r"测评|性格测试"),
)
JOBS = (
    ("算法", r"(?i)算法|机器学习|深度学习|大模型|NLP|CV|推荐|搜索"),
    ("Agent/AI 应用", r"(?i)agent|AI\s*应用|AI应用|智能体|大模型应用"),
    ("前端", r"(?i)前端|web前端|客户端|安卓|android|iOS|鸿蒙"),
    ("测试", r"(?i)测试|测开|QA"),
    ("数据", r"(?i)数据分析|数据开发|大数据|数仓|数据挖掘"),
    ("硬件/嵌入式", r"(?i)嵌入式|硬件|机电|机械|电子|驱动|FPGA|芯片|射频|光学"),
    ("游戏", r"游戏|引擎|图形|技术美术"),
    ("运维/安全", r"(?i)运维|SRE|安全|渗透"),
    ("产品/运营", r"(?i)产品经理|运营|市场|设计"),
    ("后端", r"(?i)后端|服务端|后台|全栈|Java|Golang|Go\b|C\+\+|Python|开发工程师"),
)
COMPANY_NOISE = r"面试|笔试|机试|面经|测评|秋招|春招|校招|社招|实习|暑期|提前批|正式批|内推|offer|Offer|一面|二面|三面|四面|hr|HR|招聘|岗位|简历|大厂|小厂|小公司|某公司|公司|面试官|后续|分享|记录|总结|经验|流程|收到|有人|怎么|如何|为什么|挂了|凉了|求助|请问|大家"
COMPANY_PUNCTUATION = r"[，。！？；：、,.!?;:/\\|_（）()【】\[\]{}<>《》\"\"'']"
SENTENCE_PUNCTUATION = r"[，。！？；、,.!?;~～…]|了$|吗$|吧$|呢$"
LEADING_DIGITS = r"^\d{2,4}(?:\.\d{1,2})?"
ANY_LETTER = r"[A-Za-z\p{Han}]"
NO_COMPANY_LEAD = r"^(面试|笔试|面经|秋招|春招|校招|社招|暑期|提前批|正式批|今天|昨天|分享|记录|总结|请教|求助|终于|第一次|刚|昨天|关于|聊聊)"
ROLE_WORDS = (
    "暑期实习", "暑期", "秋招", "春招", "校招", "社招", "提前批", "正式批", "实习",
    "后端开发", "服务端开发", "前端开发", "全栈开发", "软件开发", "平台开发", "中台开发",
    "算法工程师", "开发工程师", "软件工程师", "测试工程师", "研发工程师",
    "测试开发", "测开", "开发岗", "工程师", "研发", "平台", "中台",
    "后端", "服务端", "前端", "全栈", "客户端", "测试", "算法", "数据",
    "产品", "运营", "设计", "运维", "安全", "硬件", "嵌入式", "游戏", "引擎", "智能",
    "岗位", "方向", "团队", "部门", "Agent", "agent", "AI", "ai",
    "Java", "java", "Golang", "golang", "Go", "go", "Python", "python", "C++", "c++",
)
GENERIC_COMPANY_WORDS = (
    "coding", "code", "agent", "ai", "llm", "rag", "infra", "platform", "backend", "frontend", "fullstack",
    "devops", "data", "cloud", "test", "sre", "dev", "ops", "api", "sdk", "ios", "android", "web",
    "app", "demo", "project", "intern", "campus", "算法", "开发", "后端", "前端", "客户端", "测试",
    "运维", "数据", "平台", "架构", "安全", "游戏",
)
GENERIC_WORDS = (
    "智能", "技术", "科技", "软件", "信息", "网络", "系统", "平台", "中台", "中心", "事业部", "部门",
    "团队", "小组", "公司", "某公司", "大厂", "小厂", "小公司", "工程师", "开发", "研发", "岗位", "方向",
    "面试", "笔试", "面经", "秋招", "春招", "校招",
)
HEADING_LEAD = r"^[\s#*\-—–·>【\[（(》）)\]:：、.．0-9]*"
HEADINGS = (
    ("hr", "HR面", r"(?i)HR\s*面|hr面|人力面"),
    ("5", "终面", r"^终面"),
    ("4", "四面", r"^(第\s*[四4]\s*(轮|面)|四面)"),
    ("3", "三面", r"^(第\s*[三3]\s*(轮|面)|三面)"),
    ("2", "二面", r"^(第\s*[二2两]\s*(轮|面)|二面)"),
    ("1", "一面", r"^(第\s*[一1]\s*(轮|面)|一面)"),
)

# Facet values that say nothing and come last.
PLACEHOLDERS = ("其他", "其他技术", "未知", "不限", "")
NOISE = "非题目"
