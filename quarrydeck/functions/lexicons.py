"""Cue words and constants that decide results. Every operator takes its lists as a parameter; these are the defaults.

Fixed values: they must equal the ones that users' stored results were made with.
"""

# Document types by file extension, file stem and preview, in this order.
EXCEL_EXTENSIONS = ("xlsx", "xls", "xlsm", "xltx", "xltm")
STEM_CUES = (("rule", ("制度", "规定", "办法", "细则", "条例")), ("speech", ("讲话", "发言", "致辞")), ("report", ("统计", "公报", "报告")))
PREVIEW_CUES = (("rule", ("应当", "不得", "必须", "审批", "标准")), ("speech", ("强调", "指出", "提出", "要求")), ("report", ("同比", "环比", "增长", "下降", "指标", "统计")))
CODE_EXTENSIONS = ("sql", "py", "yaml", "yml", "toml", "json")
DEV_TITLE_CUES = ("schema", "draft", "ddl", "pydantic", "fastapi", "api", "ingestion-design", "knowledge-base-design")
DEV_TEXT_CUES = ("```", "class ", "def ", "create table", "select ", "sqlalchemy", "fastapi", "pydantic", "post /api", "get /api")

# Profile cue terms per document type.
PROFILE_TERMS = {
    "paper": ("摘要", "关键词", "参考文献", "实验", "算法", "模型", "方法", "研究对象", "结论", "文献综述", "学位论文"),
    "regulation": ("办法", "条例", "规定", "细则", "适用范围", "责任", "应当", "不得", "生效", "条款", "管理办法", "实施"),
    "project_plan": ("建设内容", "建设目标", "项目", "系统", "平台", "模块", "接口", "性能", "验收", "一期", "二期", "升级", "应用单位"),
    "speech": ("同志们", "会议", "强调", "指出", "部署", "贯彻", "落实", "讲话", "报告会", "精神"),
    "report": ("调研", "分析", "报告", "现状", "建议", "问题", "对策", "评估", "总结"),
    "technical_spec": ("接口", "架构", "数据库", "吞吐", "响应时间", "安全", "性能指标", "功能要求", "技术路线", "部署"),
    "table": ("合计", "金额", "单价", "数量", "指标", "清单", "明细", "表格"),
}
STRATEGIES = {"paper": "paper_extraction", "regulation": "regulation_extraction", "project_plan": "project_extraction", "speech": "speech_summary", "table": "table_attribute_first", "technical_spec": "technical_spec_extraction", "report": "report_extraction"}

# Query types by cue order.
QUERY_CUES = (("rule_qa", ("标准", "规定", "要求", "条件", "可以吗", "怎么办")), ("speech_summary", ("讲话", "强调", "重点", "任务")), ("data_qa", ("同比", "环比", "多少", "增长", "数据")), ("comparative_analysis", ("对比", "变化", "趋势", "关系", "近年")))

# Search weights: (field, phrase weight, token weight, also matched without punctuation).
DOCUMENT_FIELDS = (("title", 8.0, 3.0, True), ("filename", 8.0, 3.0, True), ("path", 6.0, 2.0, True))
UNIT_FIELDS = (("title", 3.0, 1.6, True), ("subject", 2.4, 1.3, True), ("indicator", 2.0, 1.1, True), ("normalized", 2.2, 1.2, False), ("content", 2.4, 1.4, False))
CHUNK_FIELDS = (("title", 2.4, 1.4, True), ("content", 2.0, 1.2, False))
DOC_TYPE_BONUS = {"rule": 0.08, "notice": 0.06, "report": 0.06, "minutes": 0.04, "excel": 0.03, "speech": 0.0, "unknown": -0.03}
NOISE = {"dev_title": 0.18, "dev_text": 0.06, "dev_text_max": 0.24, "code": 0.08, "table": 0.05, "link": 0.03, "least": -0.08, "most": 0.40}
SUMMARY_CUES = ("摘要", "概述", "概要", "summary", "abstract")
CAPTION_CUES = ("图", "表", "figure", "table", "sheet")
BOOST = {"phrase": 0.9, "title": 0.35, "filename": 0.2, "summary": 0.18, "caption": 0.22, "hit": 0.05, "hit_max": 0.12, "ascii_miss": 0.85, "other_miss": 0.12}

# Graph.
COMPANY_SUFFIXES = ("有限责任公司", "股份有限公司", "有限公司", "集团公司", "集团", "公司", "co.,ltd.", "co.ltd.", "coltd", "ltd")
FACT_KINDS = {
    "attribute_fact": ("attribute", "attr", "property", "attribute_fact"),
    "transition_fact": ("transition", "evolution", "transition_fact"),
    "identity_fact": ("identity", "alias", "same_as", "identity_fact"),
    "rule_fact": ("rule", "rule_fact"),
    "claim_fact": ("claim", "claim_fact"),
    "task_fact": ("task", "task_fact"),
    "event_fact": ("event", "event_fact"),
}
EVOLUTION_BLOCKED = ("建设", "负责", "依托", "应用", "支持", "包含", "隶属", "参与建设", "联系人", "申报单位", "推进", "build", "construct", "responsiblefor", "support", "supports", "dependson", "partof", "contains", "use", "uses", "appliesto", "implementedby", "isimplementedby")
EVOLUTION_SIGNALS = ("升级", "演化", "演进", "发展为", "变更为", "更名为", "替代", "取代", "迁移", "改版", "修订", "废止", "继承", "变为", "转为", "转换为", "successor", "replace", "replaces", "replacedby", "upgrade", "upgraded", "migrate", "migrated", "revise", "revision", "rename", "renamed", "supersede", "superseded", "evolv")
FUSION_GROUPS = (
    ("organization", ("org", "organization", "机构")),
    ("person", ("person", "人物", "人员")),
    ("solution", ("system", "project", "product", "platform", "系统", "项目", "平台")),
    ("normative", ("policy", "law", "standard", "制度", "规章", "标准", "法律")),
    ("knowledge", ("technology", "concept", "process", "event", "技术", "概念", "过程")),
)
ACTION_WORDS = (
    "召开", "提出", "印发", "颁布", "取消", "建设", "提升", "提高", "探索", "实现", "开展", "完成", "负责", "参与", "支持", "应用", "包含", "按照", "根据", "必须", "提供", "主持", "贯彻", "增强",
    "取得", "招收", "撤销", "增列", "准备", "遵循", "服务", "整合", "生成", "总结", "推送", "涉及", "采用", "满足", "能够", "触发", "支付", "参照", "使用", "部署", "保留", "签订", "回答", "全免", "到期", "低于", "高于", "relatedto",
)
# Attribute keys: value shapes, predicate cues (none: any predicate), key, confidence.
ATTRIBUTE_KEYS = (
    ("date", ("起始", "开始", "立项", "启动"), "起始时间", 0.90),
    ("date", ("终止", "结束", "截止", "完成"), "结束时间", 0.90),
    ("date", (), "时间", 0.90),
    ("money scalar", ("成本",), "成本", 0.90),
    ("money scalar", ("费用", "收费", "支出", "单价"), "费用", 0.90),
    ("money scalar", ("预算", "经费", "资金"), "经费", 0.90),
    ("money", (), "金额", 0.90),
    ("percent", (), "指标值", 0.90),
    ("scalar", ("指标", "达到", "不低于", "不少于", "小于", "大于", "≥", "≤"), "指标值", 0.88),
    ("scalar", ("金额",), "金额", 0.88),
    ("scalar", ("数量", "人数", "次数", "规模", "篇数", "项数"), "数量", 0.88),
    ("scalar", ("周期", "时长", "期限", "响应", "延迟", "耗时"), "周期", 0.88),
    ("scalar short_text long_text", ("版本",), "版本", 0.87),
    ("short_text long_text", ("名称", "题名", "标题"), "名称", 0.87),
    ("short_text long_text", ("简称",), "简称", 0.85),
    ("short_text long_text", ("类型", "类别", "分类"), "类型", 0.87),
    ("short_text long_text", ("状态", "阶段", "进度"), "状态", 0.87),
    ("short_text long_text", ("范围", "对象"), "范围", 0.85),
    ("short_text long_text", ("主题", "方向"), "主题", 0.85),
    ("short_text long_text", ("描述", "说明", "定义", "含义"), "描述", 0.85),
)

# Names that are no entities or topics.
STOP_NAMES = ("hyperlink", "pageref", "ref", "doi", "journal", "of", "and", "the", "to", "key", "vol", "no", "pp", "et", "al")
TITLE_HEADS = ("关于", "基于", "面向", "围绕", "有关")
TITLE_TAILS = ("研究", "分析", "探析", "综述", "报告", "方案", "通知")
TITLE_INNER = ("建设方案", "实践研究")
GENERIC_TERMS = ("领域", "专题", "知识库", "全文检索", "自动归纳候选领域", "内容", "资料", "文件", "问题", "情况", "信息", "管理", "研究", "系统", "平台", "通知", "公告", "报告")

# Fragments of scope texts.
GENERIC_FRAGMENTS = ("领域", "专题", "知识库", "相关", "内容", "资料", "文件", "问题", "要求", "情况", "信息")
CONNECTORS = "以及|及其|以及其|与|和|及|或|并|并且|相关|包括|涉及|围绕|关于|中的|中|的"
QUESTION_HEAD = "^(请问|如何|怎么|哪些|什么是|什么|用于|为了|围绕|关于)"
QUESTION_TAIL = "(有哪些|是什么|怎么做|如何做|吗|呢)$"
NEGATIVE_CUES = "(排除|不包含|不包括|不纳入范围|不纳入)"

# States by their texts: words of a phase in their order, words without meaning for a state, and texts that say nothing.
STATE_PHASES = (
    ("phase:1", ("一期", "第一阶段", "第一期", "v1", "1.0")),
    ("phase:2", ("二期", "第二阶段", "第二期", "v2", "2.0")),
    ("phase:3", ("三期", "第三阶段", "第三期", "v3", "3.0")),
    ("phase:upgrade", ("升级", "改造", "新版", "新版本")),
)
STATE_FILLERS = ("项目名称之一", "项目名称", "系统名称", "文档中提及的", "指该申报书", "指本次申报", "指代", "指", "一个具体的", "具体的", "一个", "核心", "名称", "。", "，")
STATE_EMPTY = ("项目", "系统", "项目或系统", "智慧管理系统")

# Texts of structure facts that point to noise.
STRUCTURE_NUMBERS = "「[0-9.]+」"
STRUCTURE_FIELDS = ("字段", "单价", "支出标准", "计量单位", "备注", "序号")

# Patterns of the default unit rules (CODE_HINT in any case).
NUMBER = r"(\d+(?:\.\d+)?)\s*(元/晚|元|亿元|万元|%|人|家)?"
CODE_HINT = r"(```|class\s+\w+|def\s+\w+|from\s+\w+\s+import|POST\s+/api/|GET\s+/api/)"
TIME = r"(\d{4}年(?:\d{1,2}月)?|\d{4}-\d{2}(?:-\d{2})?)"
REGION = r"((?:[\u4e00-\u9fa5]{2,12})(?:省|市|区|县))"
CONDITION = r"(符合[^，。；]{2,60}|经[^，。；]{2,40}(?:批准|同意)|在[^，。；]{2,60}情况下)"
CONSTRAINT = r"((?:不超过|不得超过|不得|必须|应当|原则上不高于)[^，。；]{2,80})"
EXCEPTION = r"(特殊情况[^，。；]{0,60}|例外情况[^，。；]{0,60}|确需[^，。；]{0,60})"
YEAR_ON_YEAR = r"同比(?:增长|下降)?\s*(\d+(?:\.\d+)?)\s*%"
MONTH_ON_MONTH = r"环比(?:增长|下降)?\s*(\d+(?:\.\d+)?)\s*%"

# Patterns of value shapes.
SHAPE_MONEY = r"[0-9]+(\.[0-9]+)?(元|万元|亿元)"
SHAPE_PERCENT = "^[0-9.]+(%|％)$"
SHAPE_YEAR = r"^(19|20)[0-9]{2}$"
SHAPE_DATE = r"^(19|20)[0-9]{2}[年./．-][0-9]{1,2}([月./．-][0-9]{1,2})?日?$"
SHAPE_STAGE = r"^(第[一二三四五六七八九十0-9]+阶段|一期|二期|三期|试点期|建设期|质保期)$"
SHAPE_SCALAR = r"^[0-9.]+([个项名所次篇位人万亿年月日小时分钟秒]+)?$"

# Structure facts: types, names and fragments that stay out or make a parent, and confidences.
STRUCTURE_LONGEST = 30
STRUCTURE_ANCHORS = ("system", "project", "policy", "standard", "organization")
STRUCTURE_TARGETS = ("organization", "document", "project", "product", "system", "policy", "process", "indicator", "concept", "technology", "resource", "requirement", "outcome", "standard")
STRUCTURE_PARENTS = ("requirement", "concept", "process", "standard", "policy", "system", "project", "technology", "resource", "outcome", "document", "product")
STRUCTURE_PARENT_PARTS = ("要求", "指标", "标准", "规范", "规则", "流程", "模块", "方案", "体系", "机制", "服务", "接口", "安全", "质量", "技术", "条件", "范围", "策略", "能力", "内容")
STRUCTURE_EXCLUDED_NAMES = ("我国", "本项目", "本系统", "项目", "系统", "平台", "高校", "院校", "功能", "关键词", "重要内容", "相关工作", "相关工作的负责人", "其他", "内容", "要求", "摘要信息", "表1", "表2")
STRUCTURE_EXCLUDED_FIELDS = ("序号", "编号", "姓名", "性别", "日期", "时间", "填报日期", "申报日期", "申报时间", "申报单位", "备注", "说明", "附件", "内部", "主要内容", "联系电话", "通讯地址")
STRUCTURE_EXCLUDED_PARTS = ("取得了", "开展了", "主持", "贯彻", "部署", "颁布", "取消", "提出", "给予", "作出", "决定", "提供")
STRUCTURE_BREAKS = ("、", "，", "；")
STRUCTURE_SURE = {"title": 0.72, "keyword": 0.68, "parent": 0.74}
