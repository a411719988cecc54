"""Article predicates: query, topic, exclusion, domain, language.

All are single Catalyst expressions, so they reach the scan or stay inside one codegen
stage.  A row without any of the consulted text passes.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions import text as X
from newsloom.functions import urls as U

DEFAULT_FIELDS = ("title", "description")
_COLUMN = {"title": "title", "description": "description", "body": "text"}


def _joined(df: DataFrame, names: list[str]) -> Column:
    """The non-empty texts of the columns, joined by a blank."""
    parts = []
    for n in names:
        if n in df.columns:
            kind = df.schema[n].dataType
            parts.append(F.array_join(F.filter(F.col(n), lambda k: k != ""), " ") if isinstance(kind, T.ArrayType) else F.col(n))
    return F.concat_ws(" ", *[F.when(p != "", p) for p in parts]) if parts else F.lit("")


def field_text(df: DataFrame, search_in: list[str] | None = None) -> Column:
    fields = search_in or DEFAULT_FIELDS
    return _joined(df, [_COLUMN[f] for f in ("title", "description", "body") if f in fields])


def topic_text(df: DataFrame) -> Column:
    return _joined(df, ["title", "description", "text", "category", "keywords"])


def _fold(hits: list[Column], mode: str) -> Column:
    return reduce(lambda a, b: a & b if mode == "all" else a | b, hits)


def _phrase(raw: str) -> str:
    return unicodedata.normalize("NFC", raw or "").strip().strip('"').strip()


def matches_query(df: DataFrame, query: str, mode: str = "any", search_in: list[str] | None = None) -> Column:
    text = field_text(df, search_in)
    terms = [t for t in [_phrase(query)] if t] if mode == "exact_phrase" else X.query_terms(query)
    if not terms:
        return F.lit(True)
    return (text == "") | _fold([X.has_term(text, t) for t in terms], mode)


def excludes_terms(df: DataFrame, terms: list[str] | None, search_in: list[str] | None = None) -> Column:
    text = field_text(df, search_in)
    found = [X.has_term(text, t) for t in map(_phrase, terms or []) if t]
    return ~_fold(found, "any") if found else F.lit(True)


def topic_terms(topic: str | list[str] | None) -> list[str]:
    if isinstance(topic, str):
        parts = topic.split(",") if "," in topic else [topic]
    else:
        parts = [str(t) for t in topic or [] if t]
    return [p.strip() for p in parts if p.strip()]


def matches_topic(df: DataFrame, topic: str | list[str] | None, mode: str = "any") -> Column:
    terms = topic_terms(topic)
    if not terms:
        return F.lit(True)
    if mode == "exact_phrase":
        terms = [" ".join(terms)]
    text = topic_text(df)
    return (text == "") | _fold([X.has_term(text, t) for t in terms], mode)


def filter_articles(
    df: DataFrame,
    query: str | None = None,
    query_mode: str = "any",
    exclude_terms: list[str] | None = None,
    search_in: list[str] | None = None,
    topic: str | list[str] | None = None,
    topic_mode: str = "any"
) -> DataFrame:
    """Query and not excluded and topic."""
    keep = F.lit(True)
    if query:
        keep = keep & matches_query(df, query, query_mode, search_in)
    if exclude_terms:
        keep = keep & excludes_terms(df, exclude_terms, search_in)
    if topic:
        keep = keep & matches_topic(df, topic, topic_mode)
    return df.where(keep)


def has_search_text(df: DataFrame, search_in: list[str] | None = None) -> Column:
    return field_text(df, search_in) != ""


#: Beyond so many listed domains each row's domain suffixes are looked up in the list.
DOMAIN_LITERALS = 200


def filter_by_domain(df: DataFrame, whitelist: list[str] | None = None, blacklist: list[str] | None = None, url: str = "url") -> DataFrame:
    """Keep the listed domains and those below them; a whitelist makes a blacklist moot."""
    listed = whitelist or blacklist
    if not listed:
        return df
    names = sorted({U.listed_domain(d) for d in listed})
    if len(names) > DOMAIN_LITERALS:
        parts = F.split(U.domain(F.col(url)), r"\.")
        suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
        hit = F.arrays_overlap(suffixes, F.lit(names))  # one literal array, looked up by hash
        return df.where(hit if whitelist else ~hit)
    host = U.domain(F.col(url))
    hit = reduce(lambda a, b: a | b, [U.under_domain(host, n) for n in names])
    return df.where(hit if whitelist else ~hit)


#: Codes that a detector may give for a language asked for.
LANGUAGE_KIN = {
    "hi": "hi mr ne", "mr": "mr hi ne", "ne": "ne hi mr", "bn": "bn as", "as": "as bn", "no": "no nb nn da",
    "nb": "nb no nn da", "nn": "nn no nb", "ms": "ms id", "id": "id ms"
}
STOP = {
    "de": "aber als auch auf aus bei das dem den der die durch ein eine einer er es für hat im in ist mit nach nicht noch oder sich sie sind um und von war wie wird zu zum zur",
    "en": "a an and are as at be but by for from has have he in is it its not of on or she that the they this to was were which will with",
    "es": "al como con cuando de del donde el ella en entre es esta este fue ha hay la las lo los más muy no o para pero por que se ser sin sobre su sus también un una y ya",
    "fr": "au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur mais ne nous on ou où par pas plus pour qu que qui sa se ses son sont sur un une vous",
    "it": "al alla anche che chi come con da dal dei del della di e gli ha il in la le lo ma nel non o per più se si sono su un una",
    "pt": "a ao as com como da das de do dos e ela em entre foi mais mas na não no nos o os ou para pela por que se sem ser seu sua são um uma",
    "nl": "aan al als bij dat de den die dit door een en er het hij ik in is maar met naar niet of om ook op over te uit van voor was werd zijn",
}


_MORE = {
    "cs": "ale až bude byl být co do ho i jak jako je jeho jen ji jsem jsou k která který na nebo po pro před při se si tak to ve však za že",
    "da": "af at blev da de den der det efter eller en er et for fra ham han har hun i ikke jeg kan man med men meget nu og om på sig skal som til var ved vi",
    "fi": "ei että he hän hänen ja jos joka kanssa kuin kun me mitä mutta myös ne niin nyt oli olla on ovat se sekä sen tai tämä vain",
    "hu": "a az csak de egy el ez hogy is itt ki kell már meg mert mint más nem nincs ott s szerint s után vagy van volt és",
    "id": "ada adalah akan atau bahwa bisa dalam dan dari dengan di harus ia ini itu juga karena ke kami mereka oleh pada para saat sudah telah tidak untuk yang",
    "no": "av at ble da de den der det eller en er et etter for fra ham han har hun i ikke jeg kan man med men mot nå og om på seg skal som til var ved vi å",
    "pl": "a ale byli być było był co czy dla do i ich jak jako jego jest jej lub ma na nie od po przez się są tak tego to tym w z za że",
    "ro": "a acest au care ce cu da de din este fost în la mai nu o pe pentru prin s sau se sunt un unei va și",
    "sv": "att av blev de den det din du efter eller en ett från för ha han har hon i inte jag kan man med men mot när och om på sig ska som till under var vi är",
    "tr": "ama bir bu çok da daha de değil diye en gibi her için ile ise kadar ki mi ne o olan olarak oldu sonra var ve veya ya",
    "vi": "bị các cho chỉ có của cũng đã để đến được không là một này như những nhưng rằng sẽ tại theo thì trong từ và vào về với",
}
STOP |= _MORE
#: Scripts with the words that tell their languages apart; where there is one language, no words.
SCRIPTS = {
    "Cyrillic": {"ru": "без был была были в во все для до его если за и из или их к как ко когда на не но о об он она они от по при с так то у что это", "uk": "або але був була в він для до з за й і їх їхній ко мав на не після при про та так те у це що як які", "bg": "без бе беше в във е за и или им как като ли на не но от по при с са се ще това той тя"},
    "Arabic": {"ar": "أن أو إلى التي الذي إن بعد بين على عن في كان كانت لا لم ما مع من هذا هذه هو هي و", "fa": "آن از است این با برای بر به تا شد شده که را در می نیز و یک های", "ur": "اس ان اور ایک پر تھا تھی سے کا کو کی کے گیا میں نے ہے ہیں"},
    "Devanagari": {"hi": "और इस एक का कि की के को था थी ने पर भी में यह से है हैं हो", "mr": "आणि आहे आहेत एक का की च ते त्या नाही मध्ये या व हा ही होते होता", "ne": "एक गरेको छ छन् त थियो न पनि भएको मा यो र रहेको लागि ले लाई हो"},
    "Han": {"zh": ""}, "Hiragana": {"ja": ""}, "Katakana": {"ja": ""}, "Hangul": {"ko": ""}, "Greek": {"el": ""}, "Hebrew": {"he": ""}, "Thai": {"th": ""},
    "Bengali": {"bn": ""}, "Tamil": {"ta": ""}, "Telugu": {"te": ""}, "Kannada": {"kn": ""}, "Malayalam": {"ml": ""}, "Gujarati": {"gu": ""}, "Gurmukhi": {"pa": ""},
    "Georgian": {"ka": ""}, "Armenian": {"hy": ""}, "Sinhala": {"si": ""}, "Khmer": {"km": ""}, "Lao": {"lo": ""}, "Myanmar": {"my": ""}, "Ethiopic": {"am": ""},
}
#: Codes that the detector can give; asking for another keeps every row.
LANGUAGES = frozenset(STOP) | {code for by_code in SCRIPTS.values() for code in by_code} | {
    k for k, v in LANGUAGE_KIN.items() if set(v.split()) & {"hi", "no", "id", "bn"}
}


def _bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` names it."""
    return F.transform(F.array(value), fn)[0]


def detect_language(text: Column, minimum: int = 12) -> Column:
    """Language code by script and by function words, null when undecided or too short.
    A native stand-in for a trained detector; ``filter_by_language`` takes any other."""

    def of_script(letters: Column) -> Column:
        shares = [F.struct(F.regexp_count(letters, F.lit(rf"\p{{Is{k}}}")).alias("n"), F.lit(k).alias("name")) for k in SCRIPTS]
        every = F.length(F.regexp_replace(text, r"\P{L}+", ""))
        top = _bound(F.sort_array(F.array(*shares), asc=False)[0], lambda t: F.when((t["n"] > 0) & (10 * t["n"] >= 3 * every), t["name"]))
        return F.when(letters != "", top)

    letters = F.regexp_replace(text, r"[\p{IsLatin}\P{L}]+", "")  # of other scripts; next to nothing in Latin texts
    kana = text.rlike(r"[\p{IsHiragana}\p{IsKatakana}]")

    def of_language(script: Column) -> Column:
        found = F.when(script.isNull(), _by_words(text, STOP))
        for name, by_code in SCRIPTS.items():
            only = F.when(kana, "ja").otherwise("zh") if name == "Han" else F.lit(next(iter(by_code)))
            found = found.when(script == name, _by_words(text, by_code) if len(by_code) > 1 else only)
        return found

    return F.when(F.length(text) >= minimum, _bound(_bound(letters, of_script), of_language))


def _by_words(text: Column, lists: dict[str, str]) -> Column:
    """The list with the most hits, where it has two at least and no equal."""

    def best_of(words: Column) -> Column:
        scores = [F.struct(F.size(_hits(words, v)).alias("n"), F.lit(k).alias("code")) for k, v in sorted(lists.items())]
        clear = lambda b: F.when((b[0]["n"] >= 2) & (b[0]["n"] > b[1]["n"]), b[0]["code"])
        return _bound(F.sort_array(F.array(*scores), asc=False), clear)

    return _bound(F.split(F.lower(text), r"[^\p{L}\p{M}]+"), best_of)


def _hits(words: Column, stop: str) -> Column:
    wanted = stop.split()
    return F.filter(words, lambda w: w.isin(*wanted))


def filter_by_language(df: DataFrame, language: str | None, detected: str | Column | Callable[[Column], Column] | None = None) -> DataFrame:
    """Keep rows in ``language`` and those that can't be told.  ``detected``: a column
    with codes, or a function from text to such a column; default the native detector."""
    if not language:
        return df
    code = language.strip().lower().replace("_", "-").split("-")[0]
    if detected is None and code not in LANGUAGES:
        return df  # the detector does not know it
    if isinstance(detected, str):
        found = F.col(detected)
    elif isinstance(detected, Column):
        found = detected
    else:
        parts = [F.coalesce(F.col(c), F.lit("")) for c in ("title", "description") if c in df.columns]
        found = (detected or detect_language)(F.concat_ws(" ", *parts))
    found = F.lower(F.substring_index(F.replace(found, F.lit("_"), F.lit("-")), "-", 1))
    return df.where(found.isNull() | (found == "") | found.isin(*LANGUAGE_KIN.get(code, code).split()))
