"""Text to tokens as Column expressions: cleaning, tokenising, filters and
normalisers. All of it runs in the JVM; functions of arrays aren't part of
generated code."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_LETTER = r"[\d\p{L}\p{Mn}]"
_INSIDE = "[\\d\\p{L}\\p{Mn}_`'‘’]"
#: A plain http address, or a word that may hold quotes and begin with # or @.
WORD = rf"http://[\w./-]+|[#@]?{_LETTER}(?:{_INSIDE}*{_LETTER})?"
EMOTICON = r"[=;:][\^o-]?[p/\\()]|[d/\\()][\^o-]?[x=;:]"
URL = r"(?:file|ftp|https?)://[\w~|!:;,.?=%/#@&+-]*"
ALL_PUNCT = "[" + r"!-/:-@\[\]^_`{-~" + "]+"
QUERY_PUNCT = r"[!?]+"
#: A letter that marks where an address began; texts lose it beforehand.
_MARK = "ꟿ"
PUNCT_TOKEN = r"[\p{P}\p{S}]+"
#: WORD and EMOTICON for any case, in forms that match without going back, and an emoticon that has a letter.
_RUN = rf"{_LETTER}+(?:[_`'‘’]++{_LETTER}+)*+"
_FAST_WORD = rf"[hH][tT][tT][pP]://[\w./-]+|[#@]?{_RUN}"
_FAST_EMOTICON = r"[=;:][\^oO-]?[pP/\\()]|[dD/\\()][\^oO-]?[xX=;:]"
_LETTERED = r"[=;:dD/\\()](?:(?<=[=;:])(?:[oO][pP/\\()]|[\^-]?[pP])|(?<=[dD])[\^oO-]?[xX=;:]|(?<=[/\\()])(?:[oO][xX=;:]|[\^-]?[xX]))"
#: Characters that texts lose.
_GONE = "[\ufeff\u200b\ufe00-\ufe0f]"
NULL_FEATURE = "FeatureNotPresent"

#: Small stop lists; other lists are passed as parameters.
STOPWORDS = {
    "en": "a about all also an and any are as at be because been but by can could did do for from had has have he her his how i if in into is it its just me more my no not now of on one only or other our out she so some than that the their them then there these they this those to up us was we were what when which who will with would you your".split(),
    "de": "aber als am an auch auf aus bei bin bis das dass dem den der des die dies du durch ein eine einem einen einer er es für hat ich ihr im in ist kann mein mich mir mit nach nicht noch nur oder sein sich sie sind so über um und uns unter vom von vor war was wenn wer wie wir wird zu zum zur".split(),
    "fr": "au aux avec ce ces dans de des du elle en est et eux il je la le les leur lui ma mais me même mes moi mon ne nos notre nous on ou où par pas pour qu que qui sa se ses son sont sur ta te tes toi ton tu un une vos votre vous".split(),
    "es": "al algo como con cual cuando de del desde donde el ella en entre era es esa ese eso esta este esto fue ha hasta hay la las le les lo los más me mi mucho muy no nos o os otro para pero por porque que quien se ser si sin sobre son su sus también te tiene todo tu un una uno y ya yo".split(),
}


def clean(text: Column) -> Column:
    """Line ends and tabs to spaces; byte-order marks, zero-width spaces and
    variation selectors go. Null stays null."""
    gone = "\ufeff\u200b" + "".join(chr(c) for c in range(0xFE00, 0xFE10))
    return F.translate(text, "\n\r\t" + gone, "   ")


def _rewrite(text: Column, pattern: str, change) -> Column:
    """Matches of a pattern changed by a Column function; the rest stays."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    pairs = F.zip_with(gaps, hits, lambda g, h: F.concat(g, F.coalesce(change(h), F.lit(""))))
    return F.when(text.rlike(pattern), F.array_join(pairs, "")).otherwise(text)


def tokenise(text: Column, lower_case: bool = True, normalise_urls: bool = False, normalise_usernames: bool = False, punctuation: str | None = None, emoticon_upper: bool = True) -> Column:
    """Tokens of short text: words, addresses, emoticons, and what matches
    ``punctuation`` where that is given. Null and blank texts have none.

    Emoticons are put in upper case, also inside words. With ``normalise_urls``
    a token that begins where an address begins becomes HTTPLINK.
    """
    t = F.coalesce(text, F.lit(""))
    if punctuation:
        t = clean(t)
    else:  # no token has white space, so only texts that lose characters need it
        t = F.when((F.octet_length(t) != F.length(t)) & t.rlike(_GONE), clean(t)).otherwise(t)
    t = F.lower(t) if lower_case else t
    if emoticon_upper:
        t = F.when(t.rlike(_LETTERED), _rewrite(t, f"(?i:{EMOTICON})", F.upper)).otherwise(t)
    if normalise_urls:
        t = _rewrite(F.translate(t, _MARK, ""), URL, lambda u: F.concat(F.lit(_MARK), F.repeat(F.lit("L"), F.length(u) - 1)))
    pattern = "|".join([_FAST_WORD, *([f"(?i:{punctuation})"] if punctuation else []), _FAST_EMOTICON])
    found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    if normalise_urls:
        found = F.transform(found, lambda x: F.when(x.startswith(_MARK), F.lit("HTTPLINK")).otherwise(F.translate(x, _MARK, "L")))
    if normalise_usernames:
        found = F.transform(found, username)
    return found


def token_pattern(punctuation: str | None = None) -> str:
    return "(?i)" + "|".join([WORD, *([punctuation] if punctuation else []), EMOTICON])


# Filters: a Column that says whether a token is to be left out.


def is_stopword(form: Column, words: Iterable[str]) -> Column:
    return F.lower(form).isin(sorted(set(words)))


def is_keyword(form: Column, words: Iterable[str]) -> Column:
    return F.lower(form).isin(sorted({w.lower() for w in words}))


def matches(form: Column, pattern: str) -> Column:
    """The whole lower-cased token matches."""
    return F.lower(form).rlike(f"^(?:{pattern})$")


def is_punctuation(form: Column, keep_queries: bool = False) -> Column:
    """Only punctuation and symbols of any script; ! and ? may be kept."""
    only = form.rlike(f"^{PUNCT_TOKEN}$")
    return only & ~form.rlike("[!?！？]") if keep_queries else only


def is_link(form: Column) -> Column:
    return form.rlike(f"^(?i:{URL})$") | (form == "HTTPLINK")


def has_pos(form: Column, pos: Column, tag: str, exceptions: Iterable[str] = ()) -> Column:
    hit = pos == tag
    return hit & ~form.isin(sorted(exceptions)) if exceptions else hit


# Normalisers: a token's new form, and for those that may end a chain whether
# they did (see corvane.plans.spec).


def by_form(form: Column, forms: Iterable[str], to: str, ignore_case: bool = False) -> tuple[Column, Column]:
    own = {f.lower() if ignore_case else f for f in forms}
    hit = (F.lower(form) if ignore_case else form).isin(sorted(own))
    return F.when(hit, F.lit(to)).otherwise(form), hit


def author(form: Column) -> tuple[Column, Column]:
    """First-person pronouns to AUTHOR, possessive ones to AUTHOR's."""
    own, have = F.lower(form).isin("i", "me", "myself", "im", "i'm"), F.lower(form).isin("my", "mine")
    return F.when(own, F.lit("AUTHOR")).when(have, F.lit("AUTHOR's")).otherwise(form), own | have


def by_match(form: Column, pattern: str, to: str) -> tuple[Column, Column]:
    hit = form.rlike(f"^(?:{pattern})$")
    return F.when(hit, F.lit(to)).otherwise(form), hit


def by_pos(form: Column, pos: Column, tags: Iterable[str], to: str) -> tuple[Column, Column]:
    hit = F.coalesce(pos.isin(sorted(tags)), F.lit(False))
    return F.when(hit, F.lit(to)).otherwise(form), hit


def username(form: Column) -> Column:
    return F.when(form.startswith("@") & (F.length(form) > 1), F.lit("USERNAME")).otherwise(form)


def repeated_letters(form: Column) -> Column:
    """Three or more of a character become two."""
    return F.regexp_replace(form, r"(.)\1{2,}", "$1$1")


def repeated_queries(form: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(form, "!{2,}", "!!"), r"\?{2,}", "??")


def strip_punctuation(form: Column, keep_twitter: bool = True) -> Column:
    """ASCII punctuation off both ends; a leading # or @ may stay."""
    every = r"[!-/:-@\[-`{-~]+"
    head = r"^(?:(?![#@])[!-/:-@\[-`{-~])+" if keep_twitter else f"^{every}"
    return F.regexp_replace(F.regexp_replace(form, head, ""), f"{every}$", "")


def replaced(form: Column, table: Mapping[str, str]) -> Column:
    pairs = [F.lit(x) for kv in sorted(table.items()) for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), form), form) if pairs else form
