"""Text functions on columns. Regular expressions carry (?U) where white space or word characters beyond ASCII count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Short replies without information.
ACKNOWLEDGEMENTS = ["ok", "okay", "sure", "thanks", "thank you", "yes", "no", "yep", "nope", "got it", "k", "yea", "yeah", "alright"]

# Words that a conversational query doesn't search for.
QUERY_STOP_WORDS = """
a an the this that these those i me my we our you your he she it they them is are was were be been being have has had do does
did will would could should can may might in on at to for of with by from about into through during before after above below
between under over and or but if then because as while when where what which who how why yesterday today tomorrow earlier later
recently ago just now thing things stuff something anything everything nothing please help find show get tell give
""".split()
QUERY_STOP_WORDS_ZH = """
我 我们 你 你们 他 她 它 他们 这 那 这个 那个 这些 那些 的 了 着 过 得 地 吗 呢 吧 啊 呀 嘛 啦 是 有 在 被 把 给 让 用 到 去 来 做 说 看 找 想 要 能
会 可以 和 与 或 但 但是 因为 所以 如果 虽然 而 也 都 就 还 又 再 才 只 之前 以前 之后 以后 刚才 现在 昨天 今天 明天 最近 东西 事情 事 什么 哪个 哪些 怎么
为什么 多少 请 帮 帮忙 告诉
""".split()

# Words that a question about evidence doesn't search for.
EVIDENCE_STOP_WORDS = """
what when where which who whom whose how why did does do is are was were the a an to of in on for with and or my your our i me
you it that this there
""".split()

MEMORY_TYPES = ["preference", "fact", "decision", "event"]


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens [a-z0-9_]+ in order of appearance; null gives none."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0)))


def strip(text: Column) -> Column:
    """text without white space, of any script, at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalise(text: Column) -> Column:
    """White space as single spaces, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def strip_fences(text: Column) -> Column:
    """text without a leading ``` or ```json and a trailing ```."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters, one at least; 0 for an empty or null text."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("int")


def memory_key(text: Column) -> Column:
    """A key of lower-case words: blanks and hyphens as one _, dots single, other signs gone."""
    key = F.lower(strip(F.coalesce(text, F.lit(""))))
    key = F.regexp_replace(F.regexp_replace(key, r"[ \t-]+", "_"), r"\.{2,}", ".")
    return F.regexp_replace(key, r"[^a-z0-9_.À-ÿ]", "")


def memory_type(kind: Column) -> Column:
    """kind, or fact where it is none of MEMORY_TYPES."""
    return F.when(kind.isin(MEMORY_TYPES), kind).otherwise("fact")


def is_low_information(text: Column) -> Column:
    """Whether a normalised text is a short acknowledgement."""
    bare = F.lower(F.regexp_replace(strip(text), r"[.!,]+$", ""))
    return (F.length(text) < 20) & ~F.contains(text, F.lit("?")) & bare.isin(ACKNOWLEDGEMENTS)


def names_and_quotes(text: Column) -> Column:
    """Lower-cased runs of capitalised words and quoted phrases, longer than one character, each once."""
    found = F.regexp_extract_all(text, F.lit(r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*|\"[^\"]+\"|'[^']+'"), F.lit(0))
    bare = F.transform(found, lambda x: F.lower(strip(F.regexp_replace(x, "^[\"']+|[\"']+$", ""))))
    return F.array_distinct(F.filter(bare, lambda x: F.length(x) > 1))


def sentences(text: Column) -> Column:
    """The sentences of a text, stripped, empty ones left out."""
    return F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?。！？])\s+"), strip), lambda x: x != "")


def query_keywords(query: Column) -> Column:
    """Search words of a conversational query, in order, each once.

    A piece with Chinese characters counts as its characters and, after them, their pairs. Stop words, ASCII words under three letters and
    numbers are left out.
    """
    pieces = F.split(strip(F.lower(F.coalesce(query, F.lit("")))), r"(?U)[\s.,!?;:\"'()\[\]{}<>/\\|@#$%^&*=+~`]+")

    def expand(piece: Column) -> Column:
        chars = F.regexp_extract_all(piece, F.lit(r"[一-鿿]"), F.lit(0))
        pairs = F.when(F.size(chars) > 1, F.zip_with(F.slice(chars, F.lit(1), F.size(chars) - 1), F.slice(chars, F.lit(2), F.size(chars) - 1), lambda a, b: F.concat(a, b))).otherwise(F.array().cast("array<string>"))
        return F.when(F.size(chars) > 0, F.concat(chars, pairs)).otherwise(F.array(piece))

    words = F.flatten(F.transform(pieces, expand))
    wanted = lambda w: (w != "") & ~w.isin(QUERY_STOP_WORDS + QUERY_STOP_WORDS_ZH) & ~(w.rlike(r"^[\x00-\x7F]*$") & (F.length(w) < 3)) & ~w.rlike(r"(?U)^\d+$")
    return F.array_distinct(F.filter(words, wanted))


def match_query(text: Column) -> Column:
    """The words of a text joined by ' & '; null without any."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\w+"), F.lit(0))
    return F.when(F.size(found) > 0, F.array_join(found, " & "))


def evidence_terms(query: Column) -> Column:
    """Terms [a-z0-9$]+ of three letters or more, without stop words, in order, each once."""
    found = F.regexp_extract_all(F.lower(query), F.lit("[a-z0-9$]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 3) & ~t.isin(EVIDENCE_STOP_WORDS)))


def conversation_lines(turns: Column) -> Column:
    """`role: content` lines of an array of (role, content)."""
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "\n")


def normalised_answer(text: Column) -> Column:
    """Lower case without articles and punctuation, single spaces."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\b(a|an|the)\b", " ")
    return normalise(F.regexp_replace(out, r"(?U)[^\w\s]", " "))


def chunks(text: Column, size: int = 1600, overlap: int = 120) -> Column:
    """Stripped pieces of `size` characters that overlap; the last is the first that reaches the end."""
    step = max(1, size - overlap)
    text = strip(F.coalesce(text, F.lit("")))
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - size) / step) * step).cast("int"), F.lit(step))
    pieces = F.transform(starts, lambda s: strip(F.substring(text, s + 1, F.lit(size))))
    return F.filter(pieces, lambda p: p != "")


def head_middle_tail(text: Column, most: int = 24000) -> Column:
    """A long text's first, middle and last thirds of `most` characters."""
    part = most // 3
    n = F.length(text)
    middle = F.substring(text, F.floor((n - part) / 2).cast("int") + 1, F.lit(part))
    return F.when(n <= most, text).otherwise(F.concat_ws("\n...\n", F.substring(text, 1, part), middle, F.substring(text, n - part + 1, F.lit(part))))


def line_scores(query: Column, text: Column) -> Column:
    """(score, line) of each sentence of a text's lines: how many of the query's terms it contains.

    Lines that start with session: or date: are left out, a leading user: or assistant: goes.
    """
    terms = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(query), F.lit("[a-z0-9$]+"), F.lit(0)), lambda t: F.length(t) >= 3))
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"), strip)
    lines = F.filter(lines, lambda x: (x != "") & ~F.lower(x).rlike("^(session|date):"))
    lines = F.transform(lines, lambda x: strip(F.regexp_replace(x, "(?i)^(user|assistant):", "")))
    parts = F.flatten(F.transform(lines, lambda x: F.filter(F.transform(F.split(x, r"(?U)(?<=[.!?])\s+"), strip), lambda p: p != "")))
    return F.transform(parts, lambda p: F.struct(F.size(F.filter(terms, lambda t: F.contains(F.lower(p), t))).alias("score"), p.alias("line")))


def truncated(text: Column, most: int) -> Column:
    """The first `most` characters; characters are code points, so none is cut in two."""
    return F.left(text, F.lit(most))

