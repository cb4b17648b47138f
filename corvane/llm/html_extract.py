"""HTML to text by two passes of block rules.

A page is cut into blocks at block-level tags and double line breaks. The
first pass classifies each block by itself from its length, the density of
stop words and the share of its characters inside links: good, bad, near-good
or short. The second pass gives near-good and short blocks the labels of the
nearest decided blocks around them. The good blocks are the text.

Defined results: a null or empty page has no blocks and an empty text; broken
mark-up is read as far as it goes, an unclosed script or comment swallows the
rest; repeated rows give repeated results; an empty table gives an empty one;
a page whose language has no list uses all lists together.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.llm._common import col
from corvane.llm._vector import column

LENGTH_LOW, LENGTH_HIGH = 70, 200
STOPS_LOW, STOPS_HIGH = 0.30, 0.32
LINKS_MOST = 0.2
HEADING_DISTANCE = 200

STOPS = {
    "en": frozenset("a about after all also an and any are as at be because been but by can could did do does for from had has have he her his how i if in into is it its just like me more most my no not now of on one only or other our out over she so some such than that the their them then there these they this those to up us was we were what when where which who will with would you your".split()),
    "fr": frozenset("à au aux avec ce ces cette dans de des du elle elles en est et été être eux il ils je la le les leur leurs lui ma mais me même mes moi mon ne nos notre nous on ont ou où par pas plus pour qu que qui sa sans se ses si son sont sur ta te tes toi ton tu un une vos votre vous y".split()),
    "de": frozenset("aber als am an auch auf aus bei bin bis da das dass dem den der des die dies diese doch du durch ein eine einem einen einer eines er es für hat hatte ich ihr im in ist ja kann mein mich mir mit nach nicht noch nur ob oder ohne sein seine sich sie sind so über um und uns unter vom von vor war was wenn wer wie wir wird zu zum zur".split()),
    "es": frozenset("a al algo ante antes como con contra cual cuando de del desde donde el ella ellas ellos en entre era es esa ese eso esta este esto estos fue ha había han hasta hay la las le les lo los más me mi mucho muy nada ni no nos nosotros o os otro para pero por porque que quien se ser si sin sobre son su sus también te tiene todo tu un una uno y ya yo".split()),
}
_ALL = frozenset().union(*STOPS.values())
_BLOCK = frozenset("address article aside blockquote body caption center col colgroup dd dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main nav noscript ol optgroup option p pre section table tbody td textarea tfoot th thead title tr ul".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|svg|head)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^<>]*>", re.S | re.I)
_LANG = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2})", re.I)
_EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "…–—“”„«»‘’"


def blocks(page: str) -> list[tuple[str, int, bool]]:
    """(text, characters inside links, is a heading) of each block."""
    out: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    state = {"links": 0, "anchor": 0, "heading": False, "breaks": 0}

    def close() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append((text, min(state["links"], len(text)), state["heading"]))
        parts.clear()
        state["links"] = 0

    def add(raw: str) -> None:
        if not raw:
            return
        parts.append(raw)
        if state["anchor"] and not raw.isspace():
            state["links"] += len(" ".join(html.unescape(raw).split()))
        if not raw.isspace():
            state["breaks"] = 0

    at = 0
    for m in _TAG.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        if not m[3]:
            continue
        name, end = m[3].lower(), bool(m[2])
        if name in _BLOCK:
            close()
            if len(name) == 2 and name[0] == "h" and name[1] in "123456":
                state["heading"] = not end
            elif not end:
                state["heading"] = False
            state["anchor"] = 0
        elif name == "a":
            state["anchor"] = 0 if end else 1
        elif name == "br":
            state["breaks"] += 1
            if state["breaks"] == 2:
                close()
            else:
                parts.append(" ")
    add(page[at:])
    close()
    return out


def first_pass(block: tuple[str, int, bool], stops: frozenset) -> str:
    text, links, _ = block
    if links / len(text) > LINKS_MOST:
        return "bad"
    if "©" in text or "&copy" in text:
        return "bad"
    if len(text) < LENGTH_LOW:
        return "bad" if links else "short"
    words = text.lower().split()
    density = sum(w in stops or w.strip(_EDGE) in stops for w in words) / len(words)
    if density >= STOPS_HIGH:
        return "good" if len(text) > LENGTH_HIGH else "near"
    return "near" if density >= STOPS_LOW else "bad"


def _nearest(labels: list[str], step: int, near: bool) -> list[str]:
    """Of each block the nearest decided label in a direction, in one pass; the
    page's edges are bad."""
    out, last = ["bad"] * len(labels), "bad"
    for i in range(len(labels))[::step]:
        out[i] = last
        if labels[i] in ("good", "bad") or near and labels[i] == "near":
            last = labels[i]
    return out


def second_pass(labels: list[str], found: list[tuple[str, int, bool]]) -> list[str]:
    labels = list(labels)
    for i, (text, _, heading) in enumerate(found):  # short headings shortly before good blocks
        if heading and labels[i] == "short":
            j, far = i + 1, 0
            while j < len(found) and far <= HEADING_DISTANCE:
                if labels[j] == "good":
                    labels[i] = "near"
                    break
                far += len(found[j][0])
                j += 1
    decided = list(labels)
    before, after = _nearest(labels, 1, False), _nearest(labels, -1, False)
    left, right = _nearest(labels, 1, True), _nearest(labels, -1, True)
    for i, label in enumerate(labels):
        if label == "short":
            if before[i] == after[i]:
                decided[i] = before[i]
            else:
                decided[i] = "good" if (left[i] if before[i] == "bad" else right[i]) == "near" else "bad"
    labels = list(decided)
    before, after = _nearest(labels, 1, False), _nearest(labels, -1, False)
    for i, label in enumerate(labels):
        if label == "near":
            decided[i] = "bad" if before[i] == after[i] == "bad" else "good"
    return decided


def extract(page: str | None) -> tuple[str, int, int]:
    """The text of a page, the number of its blocks and of the good ones."""
    if not page:
        return "", 0, 0
    found = blocks(page)
    m = _LANG.search(page)
    stops = STOPS.get(m[1].lower(), _ALL) if m else _ALL
    labels = second_pass([first_pass(b, stops) for b in found], found)
    good = [b[0] for b, x in zip(found, labels, strict=True) if x == "good"]
    return "\n".join(good), len(found), len(good)


def extract_pages(pages: DataFrame, ident: str = "page_id", text: str = "html") -> DataFrame:
    """page_id, text, n_blocks, n_good of each row."""

    def run(batches):
        for batch in batches:
            got = [extract(x) for x in column(batch, "html").to_pylist()]
            if got:
                t, n, g = zip(*got, strict=True)
                yield pa.record_batch({"page_id": column(batch, "page_id"), "text": pa.array(t, pa.string()), "n_blocks": pa.array(n, pa.int64()), "n_good": pa.array(g, pa.int64())})

    return pages.select(col(pages, ident).cast("long").alias("page_id"), col(pages, text).alias("html")).mapInArrow(run, "page_id long, text string, n_blocks long, n_good long")
