"""Column expressions over questions: modes, follow-ups, anchors, variants, intents, answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import collapse

# Words that send a question to a mode, mark follow-ups, carry no meaning, or show a refusal.
FOLLOW_UPS = ["这个", "那个", "上述", "上面", "继续", "下一步", "怎么做", "怎么办"]
FOLLOW_UP_START = "^那(?:么)?(?:个|这|他|她|它|其|负责人|项目|部分|方面|件事|一步|接下来|后来|结果|时间|原因|方案|建议|内容|问题)"
GENERIC = ["这个", "那个", "问题", "一步", "下一步", "具体", "应该", "怎么", "怎么做", "怎么办", "如何", "请", "帮", "一下", "相关", "资料", "知识库", "信息", "内容", "目前", "当前", "我的", "你", "我", "的", "和"]
NO_ANSWER = [
    "无法回答", "暂无相关内容", "无匹配来源", "没有匹配来源", "没有任何信息涉及", "没有直接涉及", "无法为您解答", "没有关于", "没有与", "还没有与", "并没有关于", "知识库缺少", "当前知识库缺少",
    "知识库中缺少", "当前知识库缺失", "知识库缺失", "没有涉及", "没有直接相关", "无直接相关", "未涉及", "未提及", "无法用来回答", "无法判断", "无适用资料", "完全不包含", "完全不相关",
    "不包含相关主题", "没有涵盖任何", "资料不足", "信息不足",
]
RELATION_EXPLAINED = [r"\bhow should\b.*\bcharts?\b.*\bread\b", r"\bhow to read\b", r"\bwhat is an org chart\b"]
RELATION = [
    r"\bstructurally under\b", r"\breport\s+to\b", r"\breports to\b", r"\bwho reports\b", r"\bpeople under\b", r"\bteams? under\b", r"\bwhich people\b.*\bunder\b", r"\bwho is responsible for\b",
    r"\bresponsible for\b", r"\bleader\b", r"\bleads?\b", r"\bunder\s+(?:him|her|them)\b", r"\bwho works with\b", r"\bwho is associated with\b", "负责", "领导", "汇报", "职位", "组织架构",
]
FOCUS_STOP = ["apac", "and", "china", "digital", "jlr", "leader", "leaders", "lead", "leads", "org", "chart", "charts", "does", "in", "position", "report", "responsible", "role", "structurally", "the", "to", "under", "what", "who", "him", "his", "her", "them"]
QUESTION_WORDS = ["What", "Which", "Who", "How", "When", "Where", "Why", "The", "This", "That"]
#: Context -> what is asked about an entity, with the reason.
VARIANTS = {
    "面试": [("面试准备", "preparation variant"), ("职位要求", "requirement variant"), ("面试复盘", "retrospective variant"), ("面试反馈", "feedback variant")],
    "项目": [("项目复盘", "retrospective variant"), ("技术选型", "technical choice variant"), ("项目经验", "lessons variant"), ("项目总结", "summary variant")],
    "": [("准备", "preparation variant"), ("复盘", "retrospective variant"), ("反馈", "feedback variant"), ("总结", "summary variant")],
}


#: Before and after a word. What \b means for letters beyond ASCII depends on the version of Java.
WORD, END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def any_of(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def answer_mode(question: Column, language: Column) -> Column:
    """struct(mode, reason) of the first rule that fits."""
    text = F.coalesce(question, F.lit(""))
    rules = [
        ((F.coalesce(language, F.lit("")) == "en") | text.rlike(r"(?i)\benglish report\b") | F.contains(text, F.lit("英文报告")), "english_report", "language_en"),
        (F.contains(text, F.lit("面试故事")) | text.rlike(r"(?i)\binterview story\b|\bSTAR\b"), "interview_story", "interview_story_keyword"),
        (F.contains(text, F.lit("复盘")) | text.rlike(r"(?i)\bretrospective\b|\blessons learned\b"), "retrospective", "retrospective_keyword"),
        (F.contains(F.upper(text), F.lit("PPT")) | F.contains(text, F.lit("幻灯片")) | F.contains(F.lower(text), F.lit("slide")), "ppt_outline", "ppt_keyword"),
        (F.contains(text, F.lit("决策")) | F.contains(F.lower(text), F.lit("decision memo")), "decision_memo", "decision_keyword"),
        (F.lit(True), "answer", "default"),
    ]
    return F.coalesce(*(F.when(test, F.struct(F.lit(mode).alias("mode"), F.lit(reason).alias("reason"))) for test, mode, reason in rules))


def is_follow_up(question: Column, markers: list[str] = FOLLOW_UPS, start: str = FOLLOW_UP_START) -> Column:
    return (question != "") & (any_of(question, markers) | question.rlike(start))


def resolved(question: Column, previous: Column, markers: list[str] = FOLLOW_UPS, start: str = FOLLOW_UP_START) -> Column:
    """struct(status, resolved_question) from a question and the one before it."""
    now, before = collapse(question), collapse(previous)
    follows = is_follow_up(now, markers, start)
    status = F.when(follows & (before == ""), "clarification_required").when(follows, "resolved").otherwise("standalone")
    text = F.when(follows & (before == ""), "").when(follows, F.concat(before, F.lit("；追问："), now)).otherwise(now)
    return F.struct(status.alias("status"), text.alias("resolved_question"))


def anchor_terms(question: Column) -> Column:
    """Distinct lower-case terms of two characters or more that aren't generic."""
    terms = F.transform(F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(r"([A-Za-z0-9]+|[\x{4e00}-\x{9fff}]{2,})"), 1), F.lower)
    return F.array_distinct(F.filter(terms, lambda t: (F.length(t) >= 2) & ~t.isin(GENERIC)))


def context_of(question: Column) -> Column:
    return (
        F.when(F.contains(question, F.lit("面试")) | question.rlike(f"(?i){WORD}interview{END}"), "面试").when(F.contains(question, F.lit("项目")) | question.rlike(f"(?i){WORD}project{END}"), "项目")
        .when(F.contains(question, F.lit("复盘")) | question.rlike(f"(?i){WORD}retrospective{END}"), "复盘").when(F.contains(question, F.lit("技术选型")), "技术选型").otherwise("")
    )


def entity_of(question: Column) -> Column:
    """The first acronym, or the first capitalised word if there is a context."""
    acronym = F.regexp_extract(question, WORD + r"([A-Z][A-Z0-9]{1,9})" + END, 1)
    names = F.filter(F.regexp_extract_all(question, F.lit(WORD + r"([A-Z][A-Za-z0-9]{1,19})" + END), 1), lambda t: ~t.isin(QUESTION_WORDS))
    return F.when(acronym != "", acronym).when(context_of(question) != "", F.coalesce(F.get(names, F.lit(0)), F.lit(""))).otherwise("")


def is_relation_question(question: Column) -> Column:
    return ~question.rlike("(?i)" + "|".join(RELATION_EXPLAINED)) & question.rlike("(?i)" + "|".join(RELATION))


def focus_tokens(question: Column) -> Column:
    found = F.regexp_extract_all(question, F.lit(r"(?<![A-Za-z])([A-Za-z]{3,})(?![A-Za-z])"), 1)
    return F.array_distinct(F.filter(found, lambda t: ~F.lower(t).isin(FOCUS_STOP)))


def under_anchors(question: Column) -> Column:
    """Words of names after 'under' or before the Chinese for it."""
    after = F.regexp_extract_all(question, F.lit(r"\bunder\s+([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)?)\b"), 1)
    before = F.regexp_extract_all(question, F.lit(r"\b([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)?)\s*(?:下面|下方|之下)"), 1)
    words = F.flatten(F.transform(F.concat(after, before), lambda n: F.regexp_extract_all(n, F.lit(r"([A-Za-z]{3,})"), 1)))
    return F.array_distinct(F.filter(words, lambda t: ~F.lower(t).isin(FOCUS_STOP)))


def page_number(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?m)^Page:[ \t]*(\d+)\s*$", 1)
    return F.when(found != "", found.cast("int"))


def is_projection(text: Column) -> Column:
    return F.startswith(text, F.lit("[ORG_CHART")) & any_of(text, ["Semantic Search Triggers:", "is structurally under", "Structure:"])


def is_no_answer(answer: Column) -> Column:
    return any_of(F.substring(collapse(answer), 1, 500), NO_ANSWER)
