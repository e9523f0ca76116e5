"""Ladders of kinds over a message's text: bids, openers, loops, rituals, shapes of questions; pictographs and hygiene."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from chorale.functions.text import has


class Kind(NamedTuple):
    """What makes a text one of a kind, each enough alone: whole words anywhere, words it opens with, a question mark, a
    link, an attachment."""

    name: str
    words: str = ""
    opening: str = ""
    asks: bool = False
    link: str = ""
    attached: bool = False


#: What a bid asks for; a text may be several.
BIDS = (
    Kind("question", opening="what|when|where|why|how|who|do|does|did|are|is|can|could|would|should|will", asks=True),
    Kind("logistics", "what time|when|where|meet|pickup|pick up|drop off|come over|heading|on my way|free|available|tonight|tomorrow|schedule|plan"),
    Kind("invitation", "want to|wanna|do you want|should we|could we|can we|let's|lets|come over|hang out|join me"),
    Kind("care", "how are you|how was|are you okay|you ok|feel better|hope you|checking in|did you sleep|how'd you sleep"),
    Kind("affection", "love you|love tons|love lots|love much|miss you|proud of you|excited to see|can't wait to see|cant wait to see"),
    Kind("repair", "sorry|apologize|apologise|my bad|forgive"),
    Kind("shared_object", link="https?://", attached=True),
)
#: The word that gives a question its shape, and the shapes that words share.
SHAPE_WORDS = "how|what|when|where|why|who|can|could|would|should|do|did|does|are|is|will"
SHAPES = {"can": "can_could", "could": "can_could", "would": "would_should", "should": "would_should", "do": "do_did", "did": "do_did", "does": "do_did", "are": "are_is", "is": "are_is"}
#: How a silence is opened; the first that fits, else ambient.
OPENERS = (
    Kind("repair", "sorry|apologize|apologise|forgive|my bad|didn'?t mean|misunderstood|i understand|that makes sense"),
    Kind("care", "how are you|how was your|are you ok|you okay|you ok|hope you|feel better|sleep well|safe|take care|checking in|did you eat"),
    Kind("affection", "love you|i love|miss you|proud of you|sweetheart|darling|cute|beautiful|handsome|kiss|cuddle|snuggle"),
    Kind("planning", "when|where|tonight|tomorrow|today|time|meet|come over|coming over|dinner|lunch|breakfast|plans?|schedule|ride|pickup|pick up|drop off|book|reservation"),
    Kind("question", opening="what|when|where|who|why|how|do you|did you|are you|can you|would you|could you", asks=True),
    Kind("play", "lol|lmao|haha|hehe|funny|silly|wild|ridiculous|joke|hilarious|codenames|wordle|factle|game"),
    Kind("object", "photo|picture|pic|screenshot|link|look at|lookit|sent you", link="(^|[^a-z0-9_])https?://[a-z0-9_]", attached=True),
    Kind("arrival", "home|got home|made it|on my way|omw|leaving|heading|headed|arrived|there yet|almost there|at work|at school"),
    Kind("status", "i'?m|i am|i just|just got|finished|woke up|going to|i think|i feel|i was"),
)
#: What a message leaves open; the first that fits, else none.
LOOPS = (
    Kind("repair", "sorry|apologize|apologise|forgive|my bad|didn'?t mean|can we talk|i understand|misunderstood"),
    Kind("care", "how are you|how was your|are you ok|you okay|you ok|did you eat|sleep well|safe|feel better|checking in|take care"),
    Kind("invitation", "want to|wanna|should we|can we|come over|come by|hang out|go to|join me|with me|let'?s"),
    Kind("logistics", "what time|when|where|which|schedule|reservation|pickup|pick up|drop off|meet|arrive|leaving|ride|address|tonight|tomorrow"),
    Kind("task", "can you|could you|would you|i'?ll|i will|remind me|need to|don'?t forget|please send|send me"),
    Kind("question", opening="what|when|where|who|why|how|do you|did you|are you|can you|would you|could you", asks=True),
)
#: What comes back day after day; a text may be several.
RITUALS = (
    Kind("morning", "good ?morning|mornin+|morning love|morning tons|gm"),
    Kind("night", "good ?night|goodnight|g ?night|night love|sweet dreams|sleep well"),
    Kind("love", "i love you|love you|love tons|love lots|love much|ily"),
    Kind("arrival", "home safe|got home|made it home|am home|i'?m home|at home|just got home"),
    Kind("motion", "on my way|omw|heading over|headed over|leaving now|be there|almost there"),
    Kind("soon", "see you soon|see soon|excited to see|can't wait to see|cant wait to see|miss you"),
    Kind("repair", "sorry|apologize|apologise|forgive"),
    Kind("thanks", "thank you|thanks|thank u|ty"),
    Kind("games", "codenames|wordle|factle|game room"),
    Kind("sleep", "sleep|sleepy|tired|bedtime|going to bed"),
)
#: The marks of game grids, which are no emoji of a conversation.
GAME_GRID = (
    "⬛", "⬜", "🟧", "🟨", "🟩", "🟦", "🟪", "🟥", "🟫",
    "⚫", "⚪", "🔴", "🟠", "🟡", "🟢", "🔵", "🟣", "🟤",
    "⭐", "✅", "❌", "➡️", "⬅️", "⬆️", "⬇️",
)
#: Unicode's Extended_Pictographic as ranges of code points, which every regex engine reads.
PICTOGRAPH = (
    "[©®‼⁉™ℹ↔-↙↩↪⌚⌛⌨⎈⏏⏩-⏳⏸-⏺Ⓜ▪▫▶◀◻-◾☀-★☇-☒☔-⚅⚐-✅✈-✒✔✖✝✡✨✳✴❄❇❌❎❓-❕❗❣-❧➕-➗➡➰➿⤴⤵⬅-⬇⬛⬜⭐⭕〰〽㊗㊙"
    "\U0001f000-\U0001f0ff\U0001f10d-\U0001f10f\U0001f12f\U0001f16c-\U0001f171\U0001f17e\U0001f17f\U0001f18e\U0001f191-\U0001f19a\U0001f1ad-\U0001f1e5"
    "\U0001f201-\U0001f20f\U0001f21a\U0001f22f\U0001f232-\U0001f23a\U0001f23c-\U0001f23f\U0001f249-\U0001f3fa\U0001f400-\U0001f53d\U0001f546-\U0001f64f"
    "\U0001f680-\U0001f6ff\U0001f774-\U0001f77f\U0001f7d5-\U0001f7ff\U0001f80c-\U0001f80f\U0001f848-\U0001f84f\U0001f85a-\U0001f85f\U0001f888-\U0001f88f"
    "\U0001f8ae-\U0001f8ff\U0001f90c-\U0001f93a\U0001f93c-\U0001f945\U0001f947-\U0001faff\U0001fc00-\U0001fffd]"
)
EMOJI = f"{PICTOGRAPH}(?:‍{PICTOGRAPH})*️?"


def plain(text: Column) -> Column:
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), "’‘", "''")


def is_kind(kind: Kind, text: Column, attached: Column) -> Column:
    body, tests = plain(text), []
    if kind.words:
        tests.append(has(body, kind.words))
    if kind.opening:
        tests.append(body.rlike(f"^({kind.opening})([^a-z0-9_]|$)"))
    if kind.asks:
        tests.append(body.contains("?"))
    if kind.link:
        tests.append(body.rlike(kind.link))
    if kind.attached:
        tests.append(attached)
    return reduce(lambda a, b: a | b, tests)


def kinds_of(ladder: tuple[Kind, ...], text: Column, attached: Column) -> Column:
    """Every kind that a text is, in the ladder's order; none of a null text without an attachment."""
    return F.array_compact(F.array(*[F.when(is_kind(k, text, attached), k.name) for k in ladder]))


def first_kind(ladder: tuple[Kind, ...], text: Column, attached: Column) -> Column:
    """The first kind that a text is, else null."""
    rules = [(is_kind(k, text, attached), F.lit(k.name)) for k in ladder]
    return reduce(lambda out, rule: out.when(*rule), rules[1:], F.when(*rules[0]))


def question_shape(text: Column) -> Column:
    word = F.regexp_extract(plain(text), f"(^|[^a-z0-9_])({SHAPE_WORDS})([^a-z0-9_]|$)", 2)
    shapes = F.create_map(*[F.lit(x) for pair in SHAPES.items() for x in pair])
    return F.when(word == "", "other").otherwise(F.coalesce(shapes[word], word))


def emoji(text: Column) -> Column:
    """Pictographs with what a joiner ties to them, but for game grids."""
    return F.filter(F.regexp_extract_all(text, F.lit(EMOJI), F.lit(0)), lambda e: ~e.isin(*GAME_GRID))


def hits(text: Column, words: tuple[str, ...], phrases: tuple[str, ...]) -> Column:
    """One for each token that is a word of the list, two for each phrase that occurs."""
    tokens = F.regexp_extract_all(plain(text), F.lit("[a-z0-9']+"), F.lit(0))
    words_hit = F.size(F.filter(tokens, lambda t: t.isin(*words)))
    return words_hit + sum((F.when(plain(text).contains(p), 2).otherwise(0) for p in phrases), F.lit(0))


def without_links(text: Column) -> Column:
    """Text without URLs and host names, its white space single."""
    bare = F.regexp_replace(F.regexp_replace(text, "(?i)https?://[^ \\t\\r\\n]+", " "), "(?i)\\b[a-z0-9.-]+\\.(com|ca|org|net|app|io|dev|co)/?[^ \\t\\r\\n]*", " ")
    return F.trim(F.regexp_replace(bare, "[ \\t\\r\\n]+", " "))


def preview(text: Column, longest: int) -> Column:
    clean = F.trim(F.regexp_replace(text, "[ \\t\\r\\n]+", " "))
    return F.when(F.length(clean) <= longest, clean).otherwise(F.concat(F.rtrim(F.substring(clean, 1, longest - 1)), F.lit("…")))


def smoothed_rate(part: Column, whole: Column, baseline: Column, prior: float = 30.0) -> Column:
    return (part + baseline * prior) / (whole + prior)


def window_lift(events: Column, of_events: Column, neutral: Column, of_neutral: Column) -> Column:
    """log2 of the odds of being in a window with an event against one without, each count half up."""
    odds = lambda n, total: (n + 0.5) / (total - n + 0.5)
    return F.log2(odds(events, of_events) / odds(neutral, of_neutral))


def confidence(method: Column, sample: Column, low: Column, high: Column, f1: Column, caveats: Column, null_value: float = 0.0) -> Column:
    """How far a figure is to be trusted; a null interval or F1 speaks neither for nor against."""
    clear = low.isNull() | (high < null_value) | (low > null_value)
    weak = (method == "speculative") | (sample < 30) | (caveats >= 3)
    strong = (sample >= 80) & clear & (f1.isNull() | (f1 >= 0.75)) & (method != "heuristic")
    return F.when(weak, "low").when(strong, "high").when(clear, "medium").otherwise("low")
