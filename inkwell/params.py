"""Word lists, thresholds and labels that operators take as parameters; these are the defaults."""

from __future__ import annotations

# Separators, stop words and stop n-grams of the term extractor.
SEPARATORS = r"(?U)[，。；、！？：''（）\s·,.;:!?()\[\]{}<>“”‘’—\-]+"
STOP_WORDS = (
    "的 了 是 在 与 和 一个 已经 他 她 它 我 你 你们 我们 他们 它们 这 那 这个 那个 会 有 被 就 还 而 中 后 前 等 其 上 下 到 从 对 把 让 很 都 也 才 "
    "但 不过 因为 所以 然后 于是 说 知道 认为 觉得 没有 不是 什么 怎么 自己 那里 这里 向 由"
).split()
STOP_NGRAMS = (
    "这是 这个 那个 一个 什么 怎么 自己 那里 这里 他们 她们 它们 我们 你们 因为 所以 然后 于是 知道 认为 觉得 可以 已经 没有 不是 还有 以及 对于 关于 如果 虽然 但是 而且 "
    "或者 不过 之间 之后 之前 时候 那样 这样 那些 这些 相关 有关 进行 出现 发生 开始 结束 属于 位于 成为 应该 可能 必须 非常 十分 只是 就是"
).split()

# Words of the style and quality gates.
FORBIDDEN_WORDS = ("突然", "忽然", "只见")
SIMILE_MARKERS = ("像", "如同", "仿佛", "好似", "宛如")
NEGATIVE_MARKERS = ("不要", "别写", "禁止", "不能写", "避免", "不要写")
DELETABLE_WORDS = ("某种",)
INNER_MARKERS = ("心想", "这很", "真", "蠢", "无聊", "烦", "没道理", "这不", "算什么")
GENERIC_CARE = ("脸色", "没事吧", "怎么了", "早点睡", "早点")
SPECIFIC_CARE = (",", "着", "塑料袋", "拉链", "袋子", "手指", "温热", "盐", "干贝", "碰撞", "沙沙")
SHOWN_CARE = ("没", "停下", "走过去", "站在原地", "回头", "迟疑", "没说话", "没应声", "没回答", "接了")
TEMPERATURE_WORDS = ("烫", "凉", "热", "温", "冰", "冷", "暖", "烧", "发烫", "发凉", "冰凉", "温热")
HUMOR_MARKERS = ("心想", "你说", "这", "卷", "懒", "吐槽", "蠢", "无聊", "没办法")
SELF_IRONY = "知道|承认|意识到|告诉自己"
SENSORY_MARKERS = ("声", "味", "气", "湿", "黏", "涩", "刺", "痛", "酸", "麻", "僵", "肿", "干", "裂")
FALSE_WORDS = ("false", "0", "no", "假", "错", "否", "非")
NORMAL_STATES = ("normal", "正常")
SENSITIVE_CATEGORIES = ("角色真相",)
OPENING_QUOTES, CLOSING_QUOTES = ('"', "「"), ('"', "」")

# Limits.
SIMILE_MOST, LENGTH_LOW, LENGTH_SHORT, LENGTH_LONG = 5, 0.5, 0.7, 1.5
DEFAULT_ALLOWED = 3
SENSORY_LEAST, SENSORY_WINDOW = 20, 2000
OBSERVED_CONFIDENCE, DEFAULT_TRUST, SENSITIVE_TRUST = 0.7, 0.5, 0.4
CONTEXT_CHARS = 4000
MEMORY_LIMIT, RECENT_CHAPTERS = 20, 2
STRONG_SCENE = 3
