"""Text rules as Spark expressions: quote boundaries, bodies, headings, genre, language tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SETTINGS

#: Where quoted history begins in a mail body. One pattern a convention; (?m) for line anchors.
QUOTE_MARKS = (
    r"(?m)^[ \t]*On\s+.{4,120}?\s+wrote:[ \t]*$",
    r"(?mi)^[ \t]*-{2,}[ \t]*(Original Message|Forwarded message|Ursprüngliche Nachricht|Message d'origine|Mensaje original)[ \t]*-{2,}[ \t]*$",
    r"(?mi)^[ \t]*(From|Von|De|差出人):[ \t]*.+\n[ \t]*(Sent|Date|Gesendet|Envoyé|送信日時):[ \t]*.+$",
    r"(?m)(^>.*$\n?){3,}",
)
SIGNATURE = r"(?m)^--\s*$"
#: Kinds of sections by heading; the first that fits wins.
HEADINGS = (
    ("REFERENCES", r"references?|bibliograph(y|ie)|literatur(verzeichnis)?|références|参考文献|reference list"),
    ("ACKNOWLEDGEMENTS", r"acknowledge?ments?|danksagung|remerciements|謝辞"),
    ("CONFLICT_OF_INTEREST", r"conflicts?\s+of\s+interest|competing\s+interests?|declaration\s+of\s+interest|interessenkonflikt|conflits?\s+d'intérêts?|利益相反"),
    ("FUNDING", r"funding( (statement|sources?))?|financial\s+support|finanzierung|financement"),
    ("ABSTRACT", r"abstract|summary|zusammenfassung|résumé|要旨|抄録"),
    ("INTRODUCTION", r"introduction|background|einleitung|hintergrund|序論|緒言"),
    ("METHODS", r"materials?\s+and\s+methods?|methods?|methodology|methoden|méthodes?|方法"),
    ("CASE_REPORT", r"case\s+(report|presentation|description|series|summary)|case\s+\d+|patient\s+[a-z0-9]+|fallbericht|fallserie|présentation\s+du\s+cas|症例|症例報告"),
    ("RESULTS", r"results?|findings|ergebnisse|résultats|結果"),
    ("DISCUSSION", r"discussions?|diskussion|考察"),
    ("CONCLUSION", r"conclusions?|schlussfolgerung(en)?|結論"),
    ("KEYWORDS", r"key\s?words?|schlüsselwörter|mots-clés|キーワード"),
)
EXCLUDED = ("REFERENCES", "ACKNOWLEDGEMENTS", "CONFLICT_OF_INTEREST", "FUNDING")
FORM_SECTION = r"(?i)^\s*(section\s+)?([A-H]|\d{1,2})[.)]\s+\S.{0,80}$"
#: Words of published articles and titles of forms.
ARTICLE_MARKS = (
    r"\babstract\b", r"\bdoi\s*:", r"\breferences\b", r"\bbibliography\b", r"\bkeywords\b", r"\bintroduction\b", r"\bdiscussion\b", r"\bcase report\b",
    r"\bcase series\b", r"\bconflict of interest\b", r"\backnowledge?ments\b", r"\bcorresponding author\b", r"\bmethods\b", r"\bconclusion\b",
    r"\bzusammenfassung\b", r"\bliteratur\b", r"\bschlussfolgerung\b", r"\brésumé\b", r"\bréférences\b", r"\bmots-clés\b", r"要旨", r"参考文献", r"考察",
)
FORM_TITLES = (
    r"\breport form\b", r"\badverse event report\b", r"\bcioms\b", r"\bpatient (initials|details)\b", r"\breporter details\b",
    r"\bbatch\s*/?\s*lot\b", r"\bmeldebogen\b", r"\bformulaire de déclaration\b", r"報告書",
)
LABEL_LINE = r"(?m)^[^\n]{0,60}?[:：]\s*\S"
#: What models call languages.
LANGUAGE_NAMES = {
    "english": "en", "eng": "en", "en-gb": "en", "en-us": "en", "german": "de", "deutsch": "de", "ger": "de", "deu": "de",
    "french": "fr", "français": "fr", "francais": "fr", "fra": "fr", "fre": "fr", "spanish": "es", "español": "es", "espanol": "es", "spa": "es",
    "italian": "it", "italiano": "it", "ita": "it", "dutch": "nl", "nederlands": "nl", "nld": "nl", "portuguese": "pt", "português": "pt", "por": "pt",
    "swedish": "sv", "svenska": "sv", "swe": "sv", "danish": "da", "dansk": "da", "dan": "da", "polish": "pl", "polski": "pl", "pol": "pl",
    "japanese": "ja", "日本語": "ja", "jpn": "ja", "chinese": "zh", "中文": "zh", "zho": "zh", "chi": "zh", "unknown": "", "none": "", "n/a": "", "und": "",
}
CJK = r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]"
NATIVE_HTML_BLOCKS = r"(?i)<(/?)(p|div|br|li|tr|h[1-6]|article|section|header|footer|ul|ol|table|blockquote|nav|title)\b[^>]*>"


def quote_start(body: Column) -> Column:
    """Code points before the quoted history, or -1: what stands before the earliest mark."""
    text = F.coalesce(body, F.lit(""))
    found = [F.when(F.regexp_like(text, F.lit(p)), F.length(F.element_at(F.split(text, p, 2), 1))) for p in QUOTE_MARKS]
    return F.when(F.trim(text) == "", -1).otherwise(F.coalesce(F.least(*found), F.lit(-1))).cast("int")


def new_text(body: Column, start: Column) -> Column:
    return F.when(start < 0, body).otherwise(F.rtrim(F.regexp_replace(F.substr(body, F.lit(1), start), r"\s+$", "")))


def quoted_text(body: Column, start: Column) -> Column:
    return F.when(start < 0, "").otherwise(F.substr(body, start + 1))


def mostly_quoted(body: Column, start: Column) -> Column:
    return (start >= 0) & (F.length(F.trim(new_text(body, start))) < SETTINGS.mostly_quoted_chars)


def without_signature(text: Column) -> Column:
    return F.when(F.regexp_like(text, F.lit(SIGNATURE)), F.regexp_replace(F.element_at(F.split(text, SIGNATURE, 2), 1), r"\s+$", "")).otherwise(text)


def flat_body(body: Column) -> Column:
    """The body as duplicates are told by: single blanks, trimmed, in lower case."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(body, F.lit("")), r"\s+", " ")))


def dedupe_key(message_id: Column, sender: Column, subject: Column, date: Column, body: Column) -> Column:
    """The Message-ID, hashed if it is long; without one a hash of sender, subject, date and body."""
    own = F.trim(message_id)
    empty = lambda c: F.coalesce(c, F.lit(""))
    content = F.concat(F.lower(empty(sender)), F.lower(empty(subject)), empty(date), flat_body(body))
    by_id = F.when(F.length(own) <= SETTINGS.dedupe_id_max_chars, own).otherwise(F.concat(F.lit("mid-sha:"), F.sha2(own, 256)))
    return F.when(empty(own) != "", by_id).otherwise(F.concat(F.lit("hash:"), F.sha2(content, 256)))


def html_text(html: Column) -> Column:
    """A page's text by substitution: scripts, styles and comments go, blocks end lines, entities are read."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>|<!--.*?-->", "")
    out = F.regexp_replace(out, NATIVE_HTML_BLOCKS, "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    out = F.regexp_replace(out, r"[ \t]*\n[ \t]*", "\n")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def heading_kind(text: Column) -> Column:
    """The section kind that a heading names, or null."""
    bare = F.trim(F.regexp_replace(F.trim(text), r"[:.]+$", ""))
    kind = F.coalesce(*[F.when(F.regexp_like(F.lower(bare), F.lit(rf"^({p})$")), F.lit(k)) for k, p in HEADINGS])
    return F.when((bare != "") & (F.length(bare) <= SETTINGS.heading_max_chars), kind)


def looks_like_heading(text: Column, bold: Column, font: Column, body_font: Column) -> Column:
    """Typography alone: short, and bold or larger than the body."""
    bare = F.trim(text)
    short = (bare != "") & (F.length(bare) <= SETTINGS.heading_max_chars) & (F.length(F.regexp_replace(bare, "[^\n]", "")) <= 1)
    return short & (bold | (font >= body_font * SETTINGS.heading_font_ratio))


def is_form_section(text: Column) -> Column:
    return F.regexp_like(F.trim(text), F.lit(FORM_SECTION))


def excluded(kind: Column) -> Column:
    return F.coalesce(kind.isin(*EXCLUDED), F.lit(False))


def printable_ratio(text: Column) -> Column:
    """The share of characters that are letters, numbers, punctuation, symbols or blanks."""
    kept = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}\p{P}\p{S}\s]", ""))
    return F.coalesce(F.try_divide(kept.cast("double"), F.length(text).cast("double")), F.lit(0.0))


def scanned_reason(chars: Column, image_area: Column, printable: Column) -> Column:
    return (
        F.when(chars < SETTINGS.scanned_min_chars, F.concat(F.lit("only "), chars.cast("string"), F.lit(" extractable characters")))
        .when(image_area > SETTINGS.scanned_image_area_ratio, "a single image covers the page")
        .when(printable < SETTINGS.scanned_printable_ratio, "the text layer is mostly not printable")
    )


def count_marks(text: Column, marks: tuple[str, ...]) -> Column:
    low = F.lower(text)
    return sum((F.regexp_like(low, F.lit(m)).cast("int") for m in marks), F.lit(0))


def genre(text: Column, columns: Column) -> Column:
    """FORM, ARTICLE or LETTER by seven steps, the first that holds."""
    articles, forms = count_marks(text, ARTICLE_MARKS), count_marks(text, FORM_TITLES)
    lines = F.length(F.regexp_replace(text, "[^\n]", "")) + 1
    density = F.regexp_count(text, F.lit(LABEL_LINE)).cast("double") / lines
    return (
        F.when((forms > 0) & (density > 0.20), "FORM")
        .when((density > 0.45) & (articles < 3), "FORM")
        .when((columns >= 2) & (articles >= 2), "ARTICLE")
        .when(articles >= 4, "ARTICLE")
        .when((columns >= 2) & (articles >= 1), "ARTICLE")
        .when(forms > 0, "FORM")
        .otherwise("LETTER")
    )


def language_code(value: Column) -> Column:
    """A two-letter code from what a model answered, or null."""
    name = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    known = F.create_map(*[F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair])
    letters = F.regexp_like(name, F.lit(r"^\p{L}+$"))
    mapped = F.element_at(known, name)
    return (
        F.when((F.length(name) == 2) & letters, name)
        .when(mapped == "", F.lit(None).cast("string"))
        .when(mapped.isNotNull(), mapped)
        .when(letters, F.substring(name, 1, 2))
    )


def share(text: Column, pattern: str) -> Column:
    """The share of a trimmed text's characters that fit the class."""
    bare = F.trim(text)
    left = F.length(F.regexp_replace(bare, pattern, ""))
    return F.coalesce(F.try_divide((F.length(bare) - left).cast("double"), F.length(bare).cast("double")), F.lit(0.0))


def is_prose(text: Column) -> Column:
    return (share(text, r"[\p{L}\s]") >= 0.70) & (share(text, r"\p{Nd}") <= 0.12)


def has_cjk(text: Column) -> Column:
    return F.regexp_like(text, F.lit(CJK))


def content_weight(text: Column) -> Column:
    """Characters, with those of dense scripts counted for more."""
    bare = F.trim(text)
    dense = F.length(bare) - F.length(F.regexp_replace(bare, CJK, ""))
    return F.length(bare) + dense * (SETTINGS.cjk_content_weight - 1)


def judgeable(text: Column) -> Column:
    """Whether a language may be told at all: long enough, three words, and prose; scripts without blanks are excused."""
    bare = F.trim(F.coalesce(text, F.lit("")))
    words = F.regexp_count(bare, F.lit(r"\S+"))
    return (F.length(bare) >= SETTINGS.lang_min_chars) & (has_cjk(bare) | ((words >= 3) & is_prose(bare)))


def needs_translation(text: Column, language: Column) -> Column:
    return language.isNotNull() & (language != "en") & (F.length(F.trim(text)) >= SETTINGS.translate_min_chars)


def redacted(text: Column, spans: Column) -> Column:
    """The text with spans (array of s, e, heading; sorted, apart) replaced by a line that says what is withheld."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, x: Column) -> Column:
        kept = F.when(x["s"] > a["at"], F.substr(text, a["at"] + 1, x["s"] - a["at"])).otherwise("")
        line = F.concat(F.lit("\n[section '"), x["heading"], F.lit("' withheld from case extraction]\n"))
        return F.struct(F.concat(a["out"], kept, line).alias("out"), F.greatest(a["at"], x["e"]).alias("at"))

    done = F.aggregate(spans, start, step)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(done["out"], F.substr(text, done["at"] + 1)))


def chunks(text: Column, size: int = SETTINGS.summary_chunk_chars) -> Column:
    """Paragraphs packed into chunks of up to ``size`` characters; a longer paragraph is a chunk of its own."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("n"))

    def step(a: Column, p: Column) -> Column:
        full = (a["n"] + F.length(p) > size) & a["open"].isNotNull()
        return F.struct(
            F.when(full, F.array_append(a["done"], a["open"])).otherwise(a["done"]).alias("done"),
            F.when(full | a["open"].isNull(), p).otherwise(F.concat(a["open"], F.lit("\n\n"), p)).alias("open"),
            (F.when(full, F.lit(0)).otherwise(a["n"]) + F.length(p) + 2).alias("n"),
        )

    return F.aggregate(F.split(text, "\n\n"), start, step, lambda a: F.array_append(a["done"], a["open"]))


#: Abbreviations whose full stop ends no sentence.
ABBREVIATION = r"(?i)\b(Dr|Mr|Mrs|Ms|Prof|St|approx|e\.g|i\.e|etc|vs|no|Fig|Ref|mg|ml)\.\s*$"


def sentence_count(text: Column) -> Column:
    """Sentences, not split after abbreviations."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    pieces = F.split(bare, r"(?<=[.!?])\s+")
    ends = F.filter(pieces, lambda p: ~F.regexp_like(p, F.lit(ABBREVIATION)))
    last_open = F.regexp_like(F.element_at(pieces, -1), F.lit(ABBREVIATION)).cast("int")
    return F.when(bare == "", 0).otherwise(F.size(ends) + last_open).cast("int")


def reply_json(raw: Column) -> Column:
    """The JSON of a model's reply: bare, or between fences; an empty object otherwise."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1)
    candidate = F.regexp_replace(F.when(fenced != "", fenced).otherwise(raw), r"^\s+|\s+$", "")
    return F.when(F.regexp_like(candidate, F.lit(r"(?s)^\{.*\}$")), candidate).otherwise("{}")


def markdown_table(headers: Column, rows: Column) -> Column:
    """Header line, rule and rows; line feeds in cells become blanks."""
    line = lambda cells: F.array_join(F.transform(cells, lambda c: F.replace(c, F.lit("\n"), F.lit(" "))), " | ")
    rule = F.array_join(F.transform(headers, lambda _: F.lit("---")), " | ")
    body = F.transform(rows, line)
    return F.array_join(F.when(F.size(headers) > 0, F.concat(F.array(line(headers), rule), body)).otherwise(body), "\n")


def clean_cell(cell: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), r"\s+", " "))


def header_key(headers: Column) -> Column:
    """A header row as continuations are told by: cleaned, lower case, empty cells at the end dropped; null if nothing is left."""
    cells = F.transform(headers, lambda c: F.lower(clean_cell(c)))
    size = F.aggregate(F.sequence(F.lit(1), F.size(cells)), F.lit(0), lambda a, i: F.when(F.element_at(cells, i) != "", i).otherwise(a))
    return F.when(size > 0, F.array_join(F.slice(cells, F.lit(1), size), "\x1f"))
