"""HTML made safe, Markdown made plain, and the markers of block translations."""

from __future__ import annotations

from collections.abc import Callable
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as T

#: What a page may hold, and what goes with all its content.
SAFE_TAGS = frozenset(
    "p br hr span div section article h1 h2 h3 h4 h5 h6 ul ol li dl dt dd strong b em i u s sup sub small mark code pre kbd samp var "
    "blockquote q cite table thead tbody tfoot tr th td caption a img figure figcaption details summary time".split()
)
DROP_TAGS = frozenset(
    "script style iframe object embed applet form input button textarea select option link meta base frame frameset noscript svg math "
    "xmp noembed noframes plaintext title".split()
)
SAFE_ATTRIBUTES = frozenset("class id title lang dir role alt width height colspan rowspan align valign start type open data-value aria-hidden aria-label".split())
ADDRESSES = frozenset("href src cite poster xlink:href".split())


def link(value: str | None) -> str:
    """As functions.text.safe_url."""
    v = (value or "").strip()
    low = v.lower().translate({9: None, 10: None, 13: None})
    if low.startswith(("//", "javascript:", "data:", "vbscript:", "file:")):
        return "#"
    known = low.startswith(("http://", "https://", "mailto:", "#", "/", "./", "../"))
    return v if known or ("://" not in v and ":" not in v.split("/")[0]) else "#"


def style(value: str | None) -> str:
    low = (value or "").lower()
    return "" if any(x in low for x in ("url(", "expression(", "javascript:", "@import")) else value or ""


class Cleaner(HTMLParser):
    """Rewrites what is allowed; all text is escaped again, entities stay."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.parts: list[str] = []
        self.inside: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.inside:
            if tag == self.inside[0]:
                self.inside.append(tag)
        elif tag in DROP_TAGS:
            self.inside.append(tag)
        elif tag in SAFE_TAGS:
            self.parts.append(f"<{tag}{''.join(self.attributes(attrs))}>")

    @staticmethod
    def attributes(attrs: list):
        for name, value in attrs:
            name = name.lower()
            kept = style(value) if name == "style" else link(value) if name in ADDRESSES else value or ""
            if name in ADDRESSES or name in SAFE_ATTRIBUTES or (name == "style" and kept):
                yield f' {name}="{escape(kept).replace("&#x27;", "&#39;")}"'

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if not self.inside and tag not in DROP_TAGS:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.inside:
            if tag == self.inside[0]:
                self.inside.pop()
        elif tag in SAFE_TAGS:
            self.parts.append(f"</{tag}>")

    def add(self, text: str) -> None:
        if not self.inside:
            self.parts.append(text)

    def handle_data(self, data: str) -> None:
        self.add(escape(data, quote=False))

    def handle_entityref(self, name: str) -> None:
        self.add(f"&{name};")

    def handle_charref(self, name: str) -> None:
        self.add(f"&#{name};")


def sanitized(html: str | None) -> str:
    """The safe subset of a page; all of it escaped if it can't be parsed."""
    cleaner = Cleaner()
    try:
        cleaner.feed(html or "")
        cleaner.close()
    except (AssertionError, ValueError, RecursionError):
        return escape(html or "", quote=False)
    return "".join(cleaner.parts)


def safe_html(c: Column) -> Column:
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(sanitized)

    return F.pandas_udf(run, "string")(c)


#: LaTeX symbols with a plain form, and digits with raised and lowered ones.
SYMBOLS = {
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "theta": "θ", "lambda": "λ", "mu": "μ", "pi": "π", "rho": "ρ", "sigma": "σ", "tau": "τ", "phi": "φ", "omega": "ω",
    "Delta": "Δ", "Omega": "Ω", "times": "×", "cdot": "·", "pm": "±", "leq": "≤", "geq": "≥", "neq": "≠", "approx": "≈", "infty": "∞", "rightarrow": "→", "partial": "∂", "sum": "∑", "int": "∫", "degree": "°",
}
RAISED, LOWERED, DIGITS = "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻", "₀₁₂₃₄₅₆₇₈₉₊₋", "0123456789+-"


def shifted(c: Column, mark: str, signs: str) -> Column:
    """Numbers after `mark`, in braces or not, in the Unicode signs for them."""
    number = rf"^{mark}\{{?([0-9+-]+)\}}?"
    piece = lambda p: F.concat(F.translate(F.regexp_extract(p, number, 1), DIGITS, signs), F.regexp_replace(p, number, ""))
    return F.array_join(F.transform(F.split(c, rf"(?={mark}\{{?[0-9+-]+\}}?)", -1), piece), "")


def plain_text(c: Column) -> Column:
    """Markdown and LaTeX as plain text: marks removed, symbols, powers and indices in Unicode."""
    t = F.regexp_replace(c, r"```[a-z]*\n?|[*`~]{1,3}|__", "")
    t = F.regexp_replace(t, r"(?m)^#{1,6}\s+", "")
    t = F.regexp_replace(t, r"\[([^\]]*)\]\([^)]*\)", "$1")
    for name, sign in SYMBOLS.items():
        t = F.regexp_replace(t, rf"\\{name}(?![A-Za-z])\s?", sign)
    t = shifted(shifted(t, r"\^", RAISED), "_", LOWERED)
    t = F.regexp_replace(t, r"\\(?:text|mathrm|mathbf)\{([^}]*)\}", "$1")
    return F.regexp_replace(t, r"\$+|\\[()\[\]]", "")


def flat(c: Column) -> Column:
    """Single line breaks as spaces; blank lines stay."""
    return F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?<!\n)\n(?!\n)", " "), F.lit(T.BLANK))


def block_input(blocks: Column) -> Column:
    """Numbered input of the blocks (i, text) that have text."""
    bare = F.transform(blocks, lambda b: F.struct(b["i"].alias("i"), F.btrim(F.coalesce(b["text"], F.lit("")), F.lit(T.BLANK)).alias("text")))
    full = F.filter(bare, lambda b: b["text"] != "")
    return F.array_join(F.transform(full, lambda b: F.concat(F.lit("⟦B"), b["i"].cast("string"), F.lit("⟧\n"), b["text"])), "\n\n")


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once a row wherever f names it, inside functions of elements too."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def block_output(raw: Column) -> Column:
    """(i, text) of a marked answer: closed pairs first, the last of a number;
    numbers without one run to the next opening mark or any closing one."""
    raw = F.coalesce(raw, F.lit(""))
    pairs = r"(?s)⟦T(\d+)⟧(.*?)⟦/T\1⟧"
    zipped = lambda ids, texts: F.filter(F.zip_with(ids, texts, lambda i, t: F.struct(i.cast("int").alias("i"), flat(t).alias("text"))), lambda b: (b["text"] != "") & b["i"].isNotNull())
    strict = zipped(F.regexp_extract_all(raw, F.lit(pairs), F.lit(1)), F.regexp_extract_all(raw, F.lit(pairs), F.lit(2)))
    strict = once(strict, lambda s: F.filter(s, lambda b, n: ~F.exists(F.slice(s, n + 2, 100_000), lambda c: c["i"] == b["i"])))
    opened = F.transform(F.slice(F.split(raw, r"⟦T\d+⟧", -1), 2, 100_000), lambda p: F.substring_index(p, "⟦/T", 1))
    loose = zipped(F.regexp_extract_all(raw, F.lit(r"⟦T(\d+)⟧"), F.lit(1)), opened)
    fresh = lambda v: F.filter(v["loose"], lambda b, n: ~F.exists(v["strict"], lambda c: c["i"] == b["i"]) & ~F.exists(F.slice(v["loose"], 1, n), lambda c: c["i"] == b["i"]))
    return once(F.struct(strict.alias("strict"), loose.alias("loose")), lambda v: F.sort_array(F.concat(v["strict"], fresh(v))))


def paragraphs_as_blocks(raw: Column, ids: Column) -> Column:
    """(i, text) of an unmarked answer, in order, if it has as many paragraphs as there are ids; else empty."""
    parts = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), r"\n\s*\n", -1), flat), lambda p: (p != "") & ~p.startswith("⟦"))
    aligned = F.zip_with(ids, parts, lambda i, t: F.struct(i.alias("i"), t.alias("text")))
    return F.when(F.size(parts) == F.size(ids), aligned).otherwise(F.array().cast("array<struct<i:int,text:string>>"))


def recognised(raw: Column, n: int, allowed: str) -> Column:
    """(i, sym) of an answer like `1=×, 2=≈`, else of a plain list in order; single allowed signs only."""
    numbered = r"(\d{1,2})\s*[=＝:：]\s*(\S)"
    good = lambda s: (F.length(s["sym"]) == 1) & (F.instr(F.lit(allowed), s["sym"]) > 0) & s["i"].between(1, n)
    make = lambda i, t: F.struct(i.cast("int").alias("i"), t.alias("sym"))
    first = F.filter(F.zip_with(F.regexp_extract_all(raw, F.lit(numbered), F.lit(1)), F.regexp_extract_all(raw, F.lit(numbered), F.lit(2)), make), good)
    parts = F.filter(F.split(raw, r"[,，、;；\s]+", -1), lambda p: p != "")
    listed = F.filter(F.transform(parts, lambda p, k: make(k + 1, p)), good)
    return F.when(F.size(first) > 0, first).otherwise(listed)


def formula_boxes(boxes: Column) -> Column:
    """The valid ones of the first 16 boxes: four finite numbers, not empty."""
    finite = lambda b: F.forall(b, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.filter(F.slice(boxes, 1, 16), lambda b: (F.size(b) == 4) & finite(b) & (F.get(b, F.lit(2)) > F.get(b, F.lit(0))) & (F.get(b, F.lit(3)) > F.get(b, F.lit(1))))


#: Signs of a used-up quota, of a mere rate limit, and those that outweigh the latter.
QUOTA = "token plan|2056|quota|额度|套餐|充值|余额|欠费|insufficient|balance|billing|exhausted"
RATE = "rate limit|too many requests|requests per minute|per-minute|rpm|qps|每秒|每分钟"
HARD = "token plan|2056|额度|套餐|充值|余额|欠费|quota exceeded|insufficient balance|insufficient_quota|out of credit|credit balance|resource exhausted|daily limit"


def quota_exhausted(status: Column, message: Column) -> Column:
    """Whether an error says that a quota is used up, and not only a rate limit."""
    m = F.lower(F.coalesce(message, F.lit("")))
    return F.coalesce((status == 429) & m.rlike(QUOTA) & (~m.rlike(RATE) | m.rlike(HARD)), F.lit(False))


def inferred_title(text: Column, stem: Column) -> Column:
    """The first line longer than 8 if it is shorter than 180 characters, else the file's stem in words."""
    first = F.get(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda s: F.btrim(s, F.lit(T.BLANK))), lambda s: F.length(s) > 8), F.lit(0))
    return F.when(F.length(first) < 180, first).otherwise(F.translate(stem, "_-", "  "))


def block_signature(blocks: Column, version: int) -> Column:
    """A cache key of the blocks' texts and the version that cut them; places don't count."""
    lines = F.transform(blocks, lambda b: F.concat(b["i"].cast("string"), F.lit(":"), F.btrim(F.coalesce(b["text"], F.lit("")), F.lit(T.BLANK))))
    return F.array_join(F.concat(F.array(F.lit(f"v{version}")), lines), "\n")


def checked_markers(c: Column) -> Column:
    """⟦TABLE:…⟧ and ⟦FORMULA:…⟧ markers with one decimal if they hold a valid box, else their kind in brackets."""
    marker = r"⟦(?:TABLE|FORMULA):[^⟧\n]*⟧"
    numbers = lambda m: F.transform(F.split(F.regexp_extract(m, r":([^⟧]*)⟧", 1), ","), lambda n: F.btrim(n, F.lit(" ")).try_cast("double"))
    sound = lambda v: (F.size(v) == 4) & F.forall(v, lambda n: n.isNotNull() & (F.abs(n) < 1e9)) & (F.get(v, F.lit(2)) > F.get(v, F.lit(0))) & (F.get(v, F.lit(3)) > F.get(v, F.lit(1)))
    kind = lambda m: F.regexp_extract(m, r"⟦(\w+):", 1)
    shown = lambda m: F.when(sound(numbers(m)), F.concat(F.lit("⟦"), kind(m), F.lit(":"), F.array_join(F.transform(numbers(m), lambda n: F.format_string("%.1f", n)), ","), F.lit("⟧"))).otherwise(F.concat(F.lit("["), kind(m), F.lit("]")))
    markers = F.regexp_extract_all(c, F.lit(marker), F.lit(0))
    return F.array_join(F.zip_with(F.split(c, marker, -1), markers, lambda gap, m: F.concat(gap, F.when(m.isNull(), "").otherwise(shown(m)))), "")


def first_translation(sources: list[tuple[Column, Column, Column]], version: int) -> Column:
    """The first of the sources (text, its version, whether it was read) that was
    read, has the current version and isn't empty; an unknown version never counts."""
    return F.coalesce(*[F.when(F.coalesce(read, F.lit(False)) & v.eqNullSafe(F.lit(version)) & (F.coalesce(t, F.lit("")) != ""), t) for t, v, read in sources])


def rate_profile(model: Column) -> Column:
    """Requests a minute by a model's name. The free model's 11, others' 30."""
    return F.when(F.contains(F.lower(F.coalesce(model, F.lit(""))), F.lit("agnes")), 11).otherwise(30)


UNTRANSLATED = "（未翻译）"


def filled_blocks(blocks: Column, got: Column, skipped: tuple[str, ...] = ("formula", "table")) -> Column:
    """blocks (i, kind, text) as (i, kind, translation): what was got (i, text)
    for a number, else a fixed placeholder; formulas and tables have none."""
    found = lambda b: F.get(F.filter(got, lambda g: g["i"] == b["i"]), F.lit(0))["text"]
    text = lambda b: F.when(~b["kind"].isin(*skipped), F.coalesce(F.nullif(found(b), F.lit("")), F.lit(UNTRANSLATED)))
    return F.transform(blocks, lambda b: F.struct(b["i"].alias("i"), b["kind"].alias("kind"), text(b).alias("translation")))


def fill_reason(filled: Column, got: Column) -> Column:
    """parse if nothing was got, partial if something is missing, else empty."""
    return F.when(F.size(got) == 0, "parse").when(F.exists(filled, lambda b: b["translation"] == UNTRANSLATED), "partial").otherwise("")


#: LaTeX commands that tell formulas from other backslashes.
COMMANDS = (
    "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi rho sigma tau upsilon phi chi psi omega varphi vartheta "
    "Gamma Delta Theta Lambda Xi Sigma Phi Psi Omega mathrm mathbf mathit mathcal mathbb mathsf boldsymbol text textbf textit operatorname "
    "overline underline frac dfrac tfrac sqrt sum prod int oint lim log ln exp sin cos tan cot sec csc arcsin cdot cdots ldots times div "
    "approx neq equiv leq geq ll gg subset subseteq supset supseteq cup cap in notin ni pm mp rightarrow leftarrow leftrightarrow Rightarrow "
    "Leftarrow to infty partial nabla forall exists propto sim cong doteq left right big Big bigg Bigg quad qquad begin end circ degree prime hbar ell"
).replace(" ", "|")
#: Braces inside braces are followed to this depth.
DEPTH = 8


def unescaped_latex(c: Column) -> Column:
    r"""A formula without needless escapes: `\/` before a command is a backslash,
    else a slash; `\{` after _ or ^ opens a group, and then `\}` closes one."""
    t = F.replace(F.regexp_replace(c, rf"\\/(?=(?:{COMMANDS})(?![A-Za-z]))", r"\\"), F.lit("\\/"), F.lit("/"))
    t = F.regexp_replace(t, r"([_^])\\\{", "$1{")
    return F.when(t.rlike(r"[_^]\{"), F.replace(t, F.lit("\\}"), F.lit("}"))).otherwise(t)


def wrapped_latex(c: Column) -> Column:
    """Known commands outside formulas between dollar signs, with the groups that follow them."""
    group = r"\{[^{}]*+\}"
    for _ in range(DEPTH - 1):
        group = rf"\{{(?:[^{{}}]++|{group})*+\}}"
    return F.regexp_replace(c, rf"\\(?:{COMMANDS})(?!\p{{L}})(?:[ \t]*(?:[_^][ \t]*)?{group})*+", r"\$$0\$")


def extracted_math(c: Column) -> Column:
    """text with @@MATHn@@ in place of formulas, n by place from 0, and formulas
    (tex, display); code stays. A formula in double dollar signs is a display if it
    has several lines or an environment or is longer than 60 characters."""
    pattern = r"```[\s\S]*?```|`[^`\n]+`|\$\$[\s\S]+?\$\$|(?<!\$)\$[^$\n]+?\$(?!\$)"
    all_ = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    is_code = lambda m: F.startswith(m, F.lit("`"))
    counts = F.aggregate(all_, F.array(F.lit(0)), lambda s, m: F.concat(s, F.array(F.element_at(s, -1) + F.when(is_code(m), 0).otherwise(1))))
    shown = F.zip_with(all_, F.slice(counts, 1, F.size(all_)), lambda m, n: F.when(is_code(m), m).otherwise(F.concat(F.lit("@@MATH"), n.cast("string"), F.lit("@@"))))
    text = F.array_join(F.zip_with(F.split(c, pattern, -1), shown, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit("")))), "")

    def formula(m: Column) -> Column:
        double = F.startswith(m, F.lit("$$"))
        tex = F.when(double, F.substring(m, F.lit(3), F.length(m) - 4)).otherwise(F.substring(m, F.lit(2), F.length(m) - 2))
        bare = F.btrim(tex, F.lit(T.BLANK))
        wide = F.contains(bare, F.lit("\n")) | bare.rlike(r"\\(?:begin|end)\s*\{[^}]+\}") | (F.length(bare) > 60)
        return F.struct(tex.alias("tex"), (double & wide).alias("display"))

    return F.struct(text.alias("text"), F.transform(F.filter(all_, lambda m: ~is_code(m)), formula).alias("formulas"))


#: What a reader sees in place of a formula or table that could not be read.
FORMULA_LOST = "【公式未能完整提取：PDF 排版导致分子/分母与上下标被打散，请对照左侧 PDF 原文】"
TABLE_LOST = "【表格未能读出，请对照左侧 PDF 原文】"


def around(c: Column, pattern: str, outside, inside) -> Column:
    """The text with `outside` of the pieces between matches and `inside` of the matches."""
    matches = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(F.split(c, pattern, -1), matches, lambda gap, m: F.concat(outside(gap), F.coalesce(inside(m), F.lit("")))), "")


def sanitized_maths(c: Column) -> Column:
    """Delimiters as dollar signs, LaTeX repaired, bare commands outside formulas
    put between dollar signs, a lone dollar sign full-width. For text without code."""
    dollars = F.regexp_replace(F.regexp_replace(c, r"(?s)\\\[(.+?)\\\]", r"\$\$$1\$\$"), r"(?s)\\\((.+?)\\\)", r"\$$1\$")
    return T.even_dollars(around(dollars, r"(?s)\$\$.+?\$\$|\$[^$\n]+?\$", lambda gap: wrapped_latex(unescaped_latex(gap)), unescaped_latex))


def sanitized_translation(c: Column) -> Column:
    """A model's translation as it is shown: line ends and leaked thoughts first,
    then maths outside code, then markers. A formula marker that isn't a box, or
    has none, and any table marker left becomes a remark. Null counts as empty."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"(?s)<think>.*?</think>", ""), r"(?s)<think>.*$", ""), "</think>", "")
    t = F.btrim(around(t, r"```[\s\S]*?```|`[^`\n]+`", sanitized_maths, lambda m: m), F.lit(T.BLANK))
    numbers = lambda m: F.transform(F.split(F.regexp_extract(m, ":([^⟧]*)⟧", 1), ",", -1), lambda n: F.btrim(n, F.lit(T.BLANK)).try_cast("double"))
    sound = lambda v: (F.size(v) == 4) & F.forall(v, lambda n: n.isNotNull()) & (F.get(v, F.lit(2)) > F.get(v, F.lit(0))) & (F.get(v, F.lit(3)) > F.get(v, F.lit(1)))
    shown = lambda m: F.when(sound(numbers(m)), F.concat(F.lit("⟦FORMULA:"), F.array_join(F.transform(numbers(m), lambda n: F.format_string("%.1f", n)), ","), F.lit("⟧"))).otherwise(FORMULA_LOST)
    t = F.replace(around(t, "⟦FORMULA:[^⟧]*⟧", lambda gap: gap, lambda m: F.when(m.isNotNull(), shown(m))), F.lit("⟦FORMULA⟧"), F.lit(FORMULA_LOST))
    return F.regexp_replace(t, "⟦TABLE[^⟧]*⟧", TABLE_LOST)


#: What a user is told of a failed call.
NO_BODY, BODY_CUT = "未产出正文", "译文不完整"
MESSAGES = {
    "no body": "模型这次没有产出任何正文（只输出了思考过程，正文为空）。换个模型再试，或把问题问得更具体一点。",
    "cut": "模型输出被长度限制截断了，回答不完整。换个模型，或缩小范围（少看上下文）再试。",
    "quota": "模型额度用完了（HTTP 429 · 配额耗尽）：套餐/余额额度已用尽，现在重试也一样。等额度恢复再试，或在 .env 里配一个你自己的模型。",
    "rate": "请求太频繁（HTTP 429 · 限流）：刚发出的请求超过了该模型的每分钟上限。等几十秒再试，或换一个模型/拉长间隔。",
    "401": "鉴权失败（HTTP 401）：API Key 无效或没有权限，检查 .env 里的 LLM_API_KEY / AGNES_API_KEY。",
    "403": "鉴权被拒（HTTP 403）：API Key 没有这个模型的权限，换一个 key 或模型。",
    "404": "接口或模型不存在（HTTP 404）：检查 .env 里的 base_url 和模型名是否写错。",
    "400": "请求被上游拒绝（HTTP 400）：模型名或参数不对，检查 .env 里的模型配置。",
}


def http_message(status: Column, message: Column) -> Column:
    """What a user is told of an HTTP status; 429 is told apart by the message."""
    told = F.when(status == 429, F.when(quota_exhausted(status, message), MESSAGES["quota"]).otherwise(MESSAGES["rate"]))
    for code in ("401", "403", "404", "400"):
        told = told.when(status == int(code), MESSAGES[code])
    number = status.cast("string")
    told = told.when(status.between(500, 599), F.concat(F.lit("上游模型服务暂时不可用（HTTP "), number, F.lit("）：稍后重试；一直失败就换个模型。")))
    return told.otherwise(F.concat(F.lit("模型接口返回错误（HTTP "), number, F.lit("）。")))


def error_message(message: Column) -> Column:
    """What a user is told of an exception: marks of missing or cut output, then
    the HTTP status it names after what comes before it, else its own first 300
    characters; secrets and local paths never show. Null counts as empty."""
    m = F.coalesce(message, F.lit(""))
    pattern = r"(?s)HTTP\s+([0-9]{3})\s*[:：]"
    status = F.regexp_extract(m, pattern, 1).try_cast("int")
    safe = lambda t: T.masked_paths(T.redacted_secrets(t))
    before = F.regexp_replace(F.regexp_extract(m, r"(?s)^(.*?)HTTP\s+[0-9]{3}\s*[:：]", 1), r"[\s:：]+$", "")
    before = safe(F.btrim(before, F.lit(T.BLANK)))
    told = http_message(status, m)
    with_before = F.when(before != "", F.concat(before, F.lit("："), told)).otherwise(told)
    return F.when(F.contains(m, F.lit(NO_BODY)), MESSAGES["no body"]).when(F.contains(m, F.lit(BODY_CUT)), MESSAGES["cut"]).when(status.isNull(), F.left(safe(m), F.lit(300))).otherwise(with_before)


#: What stands for a character that a font lacks.
FALLBACK = {
    "˒": ",", "˓": ",", "˕": "'", "ˈ": "'", "ʼ": "'", "‘": "'", "’": "'", "“": '"', "”": '"',
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-",
    "　": " ",
    "⇒": "=>", "⇐": "<=", "↔": "<->", "⇔": "<=>",
    "₊": "+", "₋": "-", "₌": "=", "₍": "(", "₎": ")", "⁺": "+", "⁻": "-", "⁼": "=", "⁽": "(", "⁾": ")",
    "ₐ": "a", "ₑ": "e", "ₒ": "o", "ₓ": "x", "ₔ": "h", "ₕ": "h", "ₖ": "k", "ₗ": "l", "ₘ": "m", "ₙ": "n", "ₚ": "p", "ₛ": "s", "ₜ": "t",
    "ᵢ": "i", "ᵣ": "r", "ᵤ": "u", "ᵥ": "v", "ᵦ": "β", "ᵧ": "γ", "ᵨ": "ρ", "ᵩ": "φ", "ᵪ": "χ", "꜀": "_C", "∼": "~",
} | {chr(start + i): str(i) for start in (0x2080, 0x2070) for i in range(10)}


def in_font(text: Column, has: list[tuple[int, int]]) -> Column:
    """The text in the characters of a font (ranges of code points, ends
    included): line ends and tabs become spaces, a missing character its
    fallback, if the font has that (those of several characters are taken to be
    there), and is left out otherwise. Runs of characters that the font has are
    passed over whole. Null counts as empty."""
    known = lambda c: any(low <= ord(c) <= high for low, high in has)
    table = {c: t for c, t in FALLBACK.items() if not known(c) and (len(t) > 1 or known(t))}
    single = {"\n": " ", "\r": " ", "\t": " "} | {c: t for c, t in table.items() if len(t) == 1}
    ranges = [*has, *((ord(c), ord(c)) for c in single | table)]
    of = lambda some: "".join(rf"\x{{{low:x}}}-\x{{{high:x}}}" for low, high in some)

    def fallen(run: Column) -> Column:
        shown = F.translate(F.regexp_replace(run, f"[^{of(ranges)}]", ""), "".join(single), "".join(single.values()))
        for c, t in table.items():
            if len(t) > 1:
                shown = F.replace(shown, F.lit(c), F.lit(t))
        return shown

    text = F.coalesce(text, F.lit(""))
    if not has:
        return fallen(text)
    held, other = rf"[{of(has)}&&[^\n\r\t]]", rf"[[^{of(has)}][\n\r\t]]"
    runs = F.regexp_extract_all(text, F.lit(f"{held}++|{other}++"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(f"^{held}"), r).otherwise(fallen(r))), "")


def listed_category(value: Column, allowed: tuple[str, ...], fallback: bool) -> Column:
    """value, error: a category of a fixed list. Another one is an error, with a null
    value; with `fallback`, it and a missing one become the first of the list."""
    known = F.coalesce(value.isin(*allowed), F.lit(False))
    other = F.lit(allowed[0]) if fallback else F.lit(None).cast("string")
    text = F.concat(F.lit("unknown category: "), F.coalesce(value, F.lit("")), F.lit("; allowed: "), F.lit(", ".join(allowed)))
    return F.struct(F.when(known, value).otherwise(other).alias("value"), F.when(~known & F.lit(not fallback), text).alias("error"))


def first_abstract(sources: list[tuple[str, Column]]) -> Column:
    """text, source: the abstract of the first source that has one, and its name.

    The first one is cleaned of tags and white space; the others are taken as they
    are and named after it, `first+name`. Without any the text is empty and the
    source is the first one.
    """
    (first, own), *others = sources
    own = F.btrim(F.regexp_replace(F.regexp_replace(F.coalesce(own, F.lit("")), "<[^>]+>", ""), r"(?U)\s+", " "))
    picked = F.when(own != "", F.struct(own.alias("text"), F.lit(first).alias("source")))
    for name, text in others:
        picked = picked.when(F.coalesce(text, F.lit("")) != "", F.struct(text.alias("text"), F.lit(f"{first}+{name}").alias("source")))
    return picked.otherwise(F.struct(F.lit("").alias("text"), F.lit(first).alias("source")))
