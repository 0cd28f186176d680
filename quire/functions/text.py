"""Text predicates, cleaning and small parsers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = " \t\n\r\x0b\x0c"
#: Canonical sections and their keywords, in order of priority.
SECTIONS = (
    ("abstract", ("abstract", "summary")),
    ("introduction", ("introduction", "background", "overview")),
    ("methods", ("methods", "method", "methodology", "approach", "experimental setup", "experimental section", "model", "framework", "experimental methods")),
    ("results", ("results", "result", "experimental result", "evaluation", "experiments", "performance")),
    ("discussion", ("discussion", "discussions")),
    ("conclusion", ("conclusion", "conclusions", "summary and outlook", "concluding remarks")),
    ("references", ("references", "reference", "bibliography")),
    ("acknowledgments", ("acknowledgments", "acknowledgement", "acknowledgements")),
)
#: Verbs that make a numbered line a sentence.
VERBS = (
    "is are was were be been being has have had did does do can could may might must shall should will would showed shown shows show "
    "measured observed reported used based obtained calculated found applied compared performed conducted discussed described presented "
    "developed proposed designed employed selected evaluated estimated simulated fabricated prepared"
)
#: Words that don't count in questions and titles.
STOP_WORDS = "the a an of in on for to is are and or this that it please summarize section".split()
CHINESE_DIGITS = "零一二三四五六七八九"
ROMAN = (("XC", 90), ("XL", 40), ("IX", 9), ("IV", 4), ("C", 100), ("L", 50), ("X", 10), ("V", 5), ("I", 1))


def count_of(text: Column, word: Column) -> Column:
    """Occurrences that don't overlap."""
    return ((F.length(text) - F.length(F.replace(text, word, F.lit("")))) / F.length(word)).cast("int")


def section_of(title: Column) -> Column:
    """The canonical section of a heading, or null: a keyword itself, then one
    between word boundaries, then one at the start; earlier keywords first."""
    t = F.btrim(F.regexp_replace(F.btrim(F.lower(title), F.lit(BLANK)), r"\.+$", ""), F.lit(BLANK))
    t = F.btrim(F.regexp_replace(t, r"^(?:\d+\.|[ivx]+\.)\s*", ""), F.lit(BLANK))
    pairs = [(k, name) for name, words in SECTIONS for k in words]
    equal, inside, start = F, F, F
    for k, name in pairs:
        equal = equal.when(t == k, name)
    for k, name in pairs:
        inside = inside.when(t.rlike(rf"(?:^|[ \t\-:.,;]){k}(?:$|[ \t\-:.,;])"), name)
    for k, name in pairs:
        start = start.when(t.rlike(rf"^{k}[ :.]"), name)
    return F.coalesce(equal, inside, start)


HEADING = r"^(\(?\d{1,2}(?:\.\d{1,2})*+\)?\.?|\(?[IVXLC]{1,6}\)?\.|\(?[A-H]\)?\.)\s+(\S.*)$"


def outline_title(line: Column) -> Column:
    """The title of a numbered heading line; null for any other line."""
    s = F.btrim(line, F.lit(BLANK))
    title = F.regexp_extract(s, HEADING, 2)
    words = F.size(F.split(title, r"\s+"))
    good = (
        (F.length(s) <= 120) & (F.length(title).between(1, 90)) & (words <= 12) & title.rlike(r"^[A-Z一-鿿]") & title.rlike(r"[a-z一-鿿]")
        & ~title.rlike(r"et al|[A-Z]\.\s|—|@|http|DOI|[,;:-]$") & ~title.rlike(rf"\b(?:{'|'.join(VERBS.split())})\b")
    )
    return F.when(good, title)


def outline_level(line: Column) -> Column:
    number = F.regexp_extract(F.btrim(line, F.lit(BLANK)), HEADING, 1)
    inner = F.btrim(number, F.lit("(). "))
    return F.when(number.startswith("("), 2).when(inner.rlike("^[IVXLC]+$"), 1).when(inner.rlike("^[A-H]$") | F.contains(inner, F.lit(".")), 2).otherwise(1)


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?。！？])\s+")


def head_tail(text: Column, limit: Column | int, marker: str = "\n\n……（中间内容已省略）……\n\n") -> Column:
    """The first and last half of a text that is too long, with a marker between."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    head = F.floor(limit / 2).cast("int")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, F.lit(1), head), F.lit(marker), F.right(text, limit - head)))


def clipped(text: Column, limit: int, share: float = 0.65) -> Column:
    """Head and tail of a text that is too long, with the number of characters left out; never clipped twice."""
    head, tail = int(limit * share), limit - int(limit * share)
    left = F.length(text) - limit
    cut = F.concat(F.left(text, F.lit(head)), F.lit("\n…["), left.cast("string"), F.lit("]…\n"), F.right(text, F.lit(tail)))
    return F.when((F.length(text) <= limit) | text.rlike(r"\n…\[[0-9]+\]…\n"), text).otherwise(cut)


def keywords(text: Column) -> Column:
    """English words of three letters or more, pairs of neighbouring Chinese
    characters, without stop words, each once."""
    t = F.lower(text)
    english = F.regexp_extract_all(t, F.lit(r"[a-z][a-z\-]{2,}"), F.lit(0))
    pairs = lambda s: F.when(F.length(s) == 1, F.array(s)).otherwise(F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2))))
    chinese = F.flatten(F.transform(F.regexp_extract_all(t, F.lit("[一-鿿]+"), F.lit(0)), pairs))
    return F.array_except(F.array_distinct(F.concat(english, chinese)), F.array(*map(F.lit, STOP_WORDS)))


def ordinal(token: Column) -> Column:
    """An Arabic, Chinese (to 99) or Roman (to 99) number; null for anything else."""
    t = F.upper(F.btrim(token, F.lit(" .,;:)")))
    place = lambda c: F.instr(F.lit(CHINESE_DIGITS), c) - 1
    head, tail = F.substring_index(t, "十", 1), F.substring_index(t, "十", -1)
    chinese = F.when(head == "", 1).otherwise(place(head)) * 10 + F.when(tail == "", 0).otherwise(place(tail))
    roman = F.lit(0)
    rest = t
    for sign, value in ROMAN:
        roman = roman + value * F.regexp_count(rest, F.lit(sign))
        rest = F.replace(rest, F.lit(sign), F.lit("-"))
    digits = F.aggregate(F.filter(F.split(t, ""), lambda c: c != ""), F.lit(0), lambda a, c: a * 10 + place(c))
    return (
        F.when(t.rlike("^[0-9]{1,9}$"), t.try_cast("int")).when(t.rlike(f"^[{CHINESE_DIGITS}]+$"), digits)
        .when(t.rlike(f"^[{CHINESE_DIGITS}]?十[{CHINESE_DIGITS}]?$"), chinese).when(t.rlike("^[IVXLC]{1,8}$"), roman)
    )


def ordinals(question: Column) -> Column:
    """Numbers of the sections a question names."""
    chinese = F.regexp_extract_all(question, F.lit(r"第\s*([0-9]{1,3}|[一二三四五六七八九十百]{1,4})\s*[节章篇部]"), F.lit(1))
    english = F.regexp_extract_all(question, F.lit(r"(?i)\b(?:section|sec\.?|chapter|part)\s*([0-9]{1,3}|[IVXLC]{1,6})\b"), F.lit(1))
    found = F.transform(F.concat(chinese, english), ordinal)
    return F.sort_array(F.array_distinct(F.filter(found, lambda n: n > 0)))


def untranslated_runs(text: Column) -> Column:
    """Runs of eight Latin words or more, but for names, addresses and captions."""
    # possessive, which finds the same runs: the engine would go a level deeper for each word
    runs = F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z'-]*(?:[ \t]+[A-Za-z][A-Za-z'-]*){7,}+"), F.lit(0))
    words = lambda r: F.split(r, r"[ \t]+")
    names = lambda r: F.forall(words(r), lambda w: w.rlike("^[A-Z]") | (F.length(w) <= 2))
    return F.filter(runs, lambda r: ~names(r) & ~r.rlike(r"(?i)https?|www|\bdoi\b|\bfig\b|\beq\b"))


def without_thoughts(text: Column) -> Column:
    """Without <think> blocks, unclosed ones and what stands before a lone closing tag."""
    t = F.regexp_replace(text, r"(?is)<think(?:ing)?>.*?</think(?:ing)?>", "")
    t = F.regexp_replace(t, r"(?is)<think(?:ing)?>.*$", "")
    return F.btrim(F.regexp_replace(t, r"(?is)^.*</think(?:ing)?>", ""), F.lit(BLANK))


def redacted_secrets(text: Column) -> Column:
    """Keys, bearer and basic credentials, key=value secrets and user parts of addresses, masked in that order."""
    t = F.regexp_replace(text, r"\bsk-[A-Za-z0-9_-]{8,}", "[REDACTED]")
    t = F.regexp_replace(t, r"(?i)\b(bearer|basic)\s+[A-Za-z0-9._~+/=-]{8,}", "$1 [REDACTED]")
    t = F.regexp_replace(t, r"""(?i)\b(api[_-]?key|token|secret|password|passwd)(["']?\s*[:=]\s*["']?)[^\s"'&,;]{4,}""", "$1$2[REDACTED]")
    return F.regexp_replace(t, r"(?i)(https?://)[^\s/@:]+:[^\s/@]+@", "$1[REDACTED]@")


def masked_paths(text: Column) -> Column:
    """Local Windows and POSIX paths as [PATH]; addresses stay."""
    t = F.regexp_replace(text, r"(?<![A-Za-z0-9])[A-Za-z]:\\[^\s\"'<>|]+", "[PATH]")
    return F.regexp_replace(t, r"(?<![A-Za-z0-9:/.])/(?:home|Users|root|tmp|var|opt|etc|mnt)/[^\s\"'<>|]+", "[PATH]")


def even_dollars(text: Column) -> Column:
    """The last $ of a line with an odd number of them becomes a full-width one."""
    fix = lambda line: F.when(count_of(line, F.lit("$")) % 2 == 1, F.regexp_replace(line, r"\$([^$]*)$", "＄$1")).otherwise(line)
    return F.array_join(F.transform(F.split(text, "\n", -1), fix), "\n")


def one_line(text: Column) -> Column:
    """Tags removed, white space collapsed."""
    return F.btrim(F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), r"\s+", " "), F.lit(" "))


def json_object(text: Column) -> Column:
    """What stands from the first { to the last } of a model's answer, if it parses; else null."""
    found = F.regexp_extract(without_thoughts(text), r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(found).isNotNull() & (found != ""), found)


def is_table(text: Column) -> Column:
    """Whether a text looks like a Markdown table."""
    return F.contains(text, F.lit("|")) & (count_of(text, F.lit("|")) >= 2)


def without_fence(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.btrim(text, F.lit(BLANK)), r"^```[A-Za-z]*\n?|\n?```$", ""), F.lit(BLANK))


def unknown_glyphs(text: Column) -> Column:
    """Runs of (cid:N) as one [?]."""
    return F.regexp_replace(F.regexp_replace(text, r"\(cid:\d+\)", "[?]"), r"\[\?\](?:\s*\[\?\])++", "[?]")


def front_matter(text: Column) -> Column:
    """The key-value lines between --- lines at the start, keys in lower case; of repeated keys the last."""
    block = F.regexp_extract(text, r"(?s)^---[ \t]*\n(.*?)\n---[ \t]*(?:\n|$)", 1)
    lines = F.filter(F.split(block, "\n"), lambda s: F.contains(s, F.lit(":")))
    bare = lambda s: F.btrim(F.btrim(s, F.lit(BLANK)), F.lit("\"'"))
    entry = lambda s: F.struct(F.lower(F.btrim(F.substring_index(s, ":", 1), F.lit(BLANK))).alias("k"), bare(F.substring(s, F.instr(s, ":") + 1, F.length(s))).alias("v"))
    entries = F.transform(lines, entry)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, 1_000_000), lambda later: later["k"] == e["k"]))
    return F.map_from_entries(last)


def first_heading(text: Column) -> Column:
    return F.btrim(F.regexp_extract(text, r"(?m)^##?[ \t]+(.+)$", 1), F.lit(BLANK))


def safe_url(url: Column) -> Column:
    """The address if a page may link to it (http, mailto, anchors, relative paths), else #; empty for null."""
    u = F.btrim(F.coalesce(url, F.lit("")), F.lit(BLANK))
    low = F.regexp_replace(F.lower(u), r"[\t\r\n]", "")
    known = low.rlike(r"^(?:https?://|mailto:|#|\.{0,2}/)")
    relative = ~F.contains(u, F.lit("://")) & ~F.contains(F.substring_index(u, "/", 1), F.lit(":"))
    return F.when(low.startswith("//") | low.rlike("^(?:javascript|data|vbscript|file):"), "#").when(known | relative, u).otherwise("#")


def public_url(url: Column) -> Column:
    """Whether an address is http(s) to a host that isn't local or private by its name."""
    host = F.lower(F.regexp_extract(F.btrim(url, F.lit(BLANK)), r"(?i)^https?://(?:[^/@]*@)?(\[[^\]]*\]|[^/:?#]+)", 1))
    private = host.rlike(r"^(?:localhost|.*\.local|.*\.internal|127\..*|10\..*|192\.168\..*|169\.254\..*|172\.(?:1[6-9]|2[0-9]|3[01])\..*|0\..*|\[.*)$")
    return F.coalesce((host != "") & ~private, F.lit(False))


def safe_style(style: Column) -> Column:
    """The style if nothing in it can load or run, else the empty string."""
    return F.when(F.lower(style).rlike(r"url\(|expression\(|javascript:|@import"), "").otherwise(F.coalesce(style, F.lit("")))


def yaml_quoted(text: Column) -> Column:
    """A double-quoted YAML scalar on one line."""
    t = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), F.regexp_replace(t, r"[\r\n]+", " "), F.lit('"'))


def token_budget(n: Column, thinks: Column) -> Column:
    """1.6 tokens a character within 4000 and 16000; 2.5 times that, up to 32000, for models that think."""
    base = F.least(F.greatest((n * 1.6).cast("int"), F.lit(4000)), F.lit(16000))
    return F.when(thinks, F.least((base * 2.5).cast("int"), F.lit(32000))).otherwise(base)


def scope_budget(n: Column, mode: Column) -> Column:
    """A budget within 300 and 80000, and the cap of its mode."""
    caps = F.when(mode == "term", 2000).when(mode == "mid", 8000).when(mode == "section", 16000).when(mode == "wide", 20000).otherwise(50000)
    return F.least(F.greatest(F.least(n, F.lit(80000)), F.lit(300)), caps)


def arxiv_id(text: Column) -> Column:
    return F.regexp_extract(text, r"(?i)(?:arxiv[:/.\s]*(?:org/(?:abs|pdf)/)?)?(\d{4}\.\d{4,5})(?:v\d+)?", 1)


def doi(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(text, r"(?i)(10\.\d{4,9}/[^\s\"'<>]+)", 1), r"[.,;)]+$", ""))


def streamed_text(body: Column) -> Column:
    """The content of server-sent data lines in order; lines that don't parse are passed over."""
    lines = F.filter(F.split(body, "\n"), lambda s: s.startswith("data:"))
    payload = F.transform(lines, lambda s: F.btrim(F.substring(s, F.lit(6), F.length(s)), F.lit(BLANK)))
    parts = F.transform(F.filter(payload, lambda p: p != "[DONE]"), lambda p: F.coalesce(F.get_json_object(F.when(F.try_parse_json(p).isNotNull(), p), "$.content"), F.lit("")))
    return F.array_join(parts, "")


def normal_title(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[^a-zA-Z0-9一-龥]", ""))


def title_words(text: Column) -> Column:
    words = F.transform(F.split(text, r"\W+"), normal_title)
    return F.slice(F.filter(words, lambda w: F.length(w) >= 3), 1, 8)


#: Short words that make a line of short words prose.
SHORT_WORDS = (
    "a an the and or but nor for yet so in on at to of by as is are was be am it its we us our he she not no if do did can may has had who how why all any each few own too one two via per etc vs"
)
#: Signs of a relation, signs of a broken formula, markers of unknown symbols.
RELATION = "[=≈≤≥¼]"
FRAGMENT = r"[ðÞ\[\]()]"
UNKNOWN = r"\[\?\]|⟦G:\d+⟧"
DIGIT = r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]"


def mathish(line: Column) -> Column:
    """Whether a line is a formula or a piece of one: prose has two words of three letters or more."""
    s = F.btrim(F.coalesce(line, F.lit("")), F.lit(BLANK))
    bare = F.regexp_replace(s, rf"\(cid:\d+\)|{UNKNOWN}", " ")
    words = F.size(F.filter(F.split(bare, "[^A-Za-z]+"), lambda w: F.length(w) >= 3))
    small = F.filter(F.split(F.lower(s), "[^a-z]+"), lambda w: w != "")
    prose = ~s.rlike(DIGIT) & ~s.rlike(FRAGMENT) & (F.size(small) > 0) & F.forall(small, lambda w: w.isin(*SHORT_WORDS.split()))
    letters = F.length(F.regexp_replace(s, "[^A-Za-z]", ""))
    short = s.rlike(r"^[A-Za-z]{1,3}(?:\s+[A-Za-z]{1,3})*+$")
    return (
        F.when((s == "") | (F.length(s) > 200) | (words >= 2), False).when(s.rlike(RELATION), F.length(s) <= 160).when(s.rlike(rf"\(cid:|{UNKNOWN}"), True)
        .when((letters <= 2) & (F.length(s) <= 12), ~prose).when(short & prose, False).otherwise(s.rlike(DIGIT) | s.rlike(FRAGMENT) | short)
    )


MARKER = r"⟦(?:(?:FORMULA|TABLE):[^⟧\n]*|G:\d+)⟧"


def trimmed_tail(page: Column, most: int = 1500) -> Column:
    """A page without page numbers at its end and without what follows its last
    sentence end or marker, if that is `most` characters or less. Full stops
    inside markers end no sentence, and a marker's end is a place to cut."""
    bare = F.regexp_replace(F.coalesce(page, F.lit("")), r"(?:(?:^|\n)[ \t\r]*\d{1,4}[ \t\r]*)++$", "")
    text = F.regexp_replace(bare, r"\s+$", "")
    last = F.element_at(F.split(text, MARKER, -1), -1)
    head = F.left(text, F.length(text) - F.length(last))
    kept = F.concat(head, F.regexp_extract(last, r"(?s)^(.*[.!?。！？])", 1))
    cut = (kept != "") & (F.length(text) - F.length(kept) <= most)
    return F.btrim(F.when(cut, kept).otherwise(text), F.lit(BLANK))


NUMBERED = r"^\(?\d{1,2}(?:\.\d{1,2})*+\)?\.?\s+[A-Z(]|^\(?[IVXLC]{1,6}\)?\.?\s+[A-Z]"


def heading_prefix(first: Column, second: Column) -> Column:
    """How many of a block's first two lines are a section heading: 0, 1, or 2 if the second continues it."""
    a, b = (F.btrim(F.coalesce(c, F.lit("")), F.lit(BLANK)) for c in (first, second))
    words = lambda t: F.size(F.split(t, r"\s+"))
    heading = a.rlike(NUMBERED) & (F.length(a) <= 85) & (words(a) <= 8) & ~a.rlike(r"[.,;:-]$|…| \. |\. \. \.|et al")
    capitals = (F.upper(b) == b) & (F.lower(b) != b)
    goes_on = b.rlike(r"^[\p{Lu}(\[]") & ~b.rlike(NUMBERED) & ~b.endswith("-") & ~capitals & (F.length(b) <= 70) & (words(b) <= 6)
    return F.when(heading, F.when(goes_on, 2).otherwise(1)).otherwise(0)
