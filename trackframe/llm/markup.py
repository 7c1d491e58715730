"""A tolerant reader of HTML: elements, blocks of text and hashes of subtrees.

Tags end blocks; nothing else is required of a page. Unclosed and unopened tags are repaired
the simple way: a closing tag closes up to the nearest open element of its name, or nothing.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

# A quote opens a value only right after the equals sign; a value without its second quote ends at the next >.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*)(?:>|\Z)""", re.DOTALL)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.IGNORECASE)
SPLIT = re.compile(r"[^a-z]+")

# Element names and the words in class, id and role that name page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math canvas object audio video textarea select title".split())
FURNITURE = frozenset("head nav footer aside form button menu dialog".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
FURNITURE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead ad ads advert adverts advertisement advertising sponsored sponsor promo banner "
    "cookie cookies consent gdpr notice notices popup modal newsletter subscribe signup share sharing social related recommended comment comments reply replies "
    "discussion disqus widget toolbar pagination pager skip legal disclaimer copyright login search contentinfo complementary banner dialog alert hidden".split()
)
#: a subtree of fewer words may recur without being a template
LEAST_WORDS = 4
#: base and modulus of the hash of a run of blocks
BASE, PRIME = 0x5BD1E9955BD1E995, (1 << 61) - 1
#: an opening tag of the first kind ends an open element of the second
ENDS_P = BLOCK - {"body", "html", "head"}


@dataclass
class Element:
    tag: str
    parent: int
    furniture: bool
    article: bool


@dataclass
class Page:
    elements: list[Element]
    blocks: list[tuple[int, str]]  # (innermost element, text) in page order

    def subtrees(self) -> dict[int, tuple[int, int, int]]:
        """(hash of the text, first block, block after the last) of every element with text, but roots of articles, cells of tables in them and what holds a whole page.

        Blocks of an element stand together, so that one pass from the last element to the
        first gives all spans, and a span's hash follows from two prefix hashes.
        """
        n = len(self.elements)
        first, last = [len(self.blocks)] * n, [0] * n
        for i, (k, _) in enumerate(self.blocks):
            if k >= 0:
                first[k], last[k] = min(first[k], i), i + 1
        for k in range(n - 1, -1, -1):  # parents come before their children
            up = self.elements[k].parent
            if up >= 0:
                first[up], last[up] = min(first[up], first[k]), max(last[up], last[k])
        prefix, power = [0], [1]
        for _, text in self.blocks:
            prefix.append((prefix[-1] * BASE + digest(text)) % PRIME)
            power.append(power[-1] * BASE % PRIME)
        out = {}
        for k, e in enumerate(self.elements):
            root = e.tag == "article" and not (e.parent >= 0 and self.elements[e.parent].article)
            if last[k] and e.tag not in ("html", "body", "main") and not root and not (e.article and e.tag in ("td", "th")):
                a, z = first[k], last[k]
                out[k] = (prefix[z] - prefix[a] * power[z - a]) % PRIME, a, z
        return out

    def candidates(self) -> set[tuple[int, int, bool, bool]]:
        """(hash, context, short, shown) of the subtrees; shown if a part of the main text is inside.

        The context is the block of the main text outside the subtree with the smallest hash: copies of a page
        have one context, near copies few, pages that share nothing but the subtree have one each. A
        subtree that holds the whole main text has none and is left out.
        """
        marks = [digest(t) for _, t in self.blocks]
        places: dict[int, list[int]] = {}
        for i, m in enumerate(marks):
            places.setdefault(m, []).append(i)
        shown = set(self.main_blocks())
        main = sorted({marks[i] for i in shown})
        words, seen = [0], [0]
        for i, (_, text) in enumerate(self.blocks):
            words.append(words[-1] + len(text.split()))
            seen.append(seen[-1] + (i in shown))

        def inside(m: int, a: int, z: int) -> bool:
            at = bisect_left(places[m], a)
            return at < len(places[m]) and places[m][at] < z

        out = set()
        for h, a, z in set(self.subtrees().values()):
            context = next((m for m in main if not inside(m, a, z)), None)
            if context is not None:
                out.add((h, context, words[z] - words[a] < LEAST_WORDS, seen[z] > seen[a]))
        return out

    def main_blocks(self, template: frozenset[int] | set[int] = frozenset()) -> list[int]:
        """Numbers of the blocks of main_text."""
        gone = {k for k, (h, _, _) in self.subtrees().items() if h in template} if template else set()
        removed: list[bool] = []  # parents come before their children
        for k, e in enumerate(self.elements):
            removed.append(k in gone or e.furniture or e.parent >= 0 and removed[e.parent])
        kept = [i for i, (k, _) in enumerate(self.blocks) if k < 0 or not removed[k]]
        for tag in ("article", "main"):
            if any(e.tag == tag and not removed[i] for i, e in enumerate(self.elements)):
                under: list[bool] = []
                for e in self.elements:
                    under.append(e.tag == tag or e.parent >= 0 and under[e.parent])
                return [i for i in kept if self.blocks[i][0] >= 0 and under[self.blocks[i][0]]]
        return kept

    def main_text(self, template: frozenset[int] | set[int] = frozenset()) -> str:
        """Blocks outside furniture and outside the subtrees hashed in `template`; of articles if the page has any, else of its main part, else all."""
        return "\n\n".join(self.blocks[i][1] for i in self.main_blocks(template))


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def whole_names(value: str) -> bool:
    """Whether a name in the list says nothing but furniture: `ad` and `social-share` do, `share-price` does not."""
    return any(parts and FURNITURE_WORDS.issuperset(parts) for parts in ([p for p in SPLIT.split(name) if p] for name in value.split()))


def is_furniture(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in FURNITURE or tag == "header" and not in_article:
        return True
    if tag in ("html", "body", "main") or not attributes:
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name in ("class", "id", "role") and (whole_names(value) if in_article else FURNITURE_WORDS.intersection(SPLIT.split(value))):
            return True
    return False


def parse(source: str) -> Page:
    elements: list[Element] = []
    blocks: list[tuple[int, str]] = []
    stack: list[int] = []
    opened: Counter[str] = Counter()  # names on the stack, so that a stray closing tag costs no search
    parts: list[str] = []
    owner = -1

    def flush() -> None:
        nonlocal owner
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append((owner, text))
            parts.clear()
        owner = -1

    def add(text: str) -> None:
        nonlocal owner
        if owner < 0 and stack:
            owner = stack[-1]
        parts.append(text)

    def close(k: int) -> None:
        opened.subtract(elements[s].tag for s in stack[k:])
        del stack[k:]

    at = 0
    size = len(source)
    while at < size:
        m = TAG.search(source, at)
        if m is None:
            add(source[at:])
            break
        if m.start() > at:
            add(source[at : m.start()])
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        if m.group(1):
            if tag in BLOCK:
                flush()
            for k in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if elements[stack[k]].tag == tag:
                    if any(elements[s].tag in BLOCK for s in stack[k:]):
                        flush()
                    close(k)
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(source, at)
            if not m.group(3).rstrip().endswith("/"):
                at = end.end() if end else size
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCK:
            flush()
            if tag in ENDS_P:
                for k in range(len(stack) - 1, -1, -1):
                    name = elements[stack[k]].tag
                    if name == "p" or name == tag == "li" or name == tag and tag in ("td", "th", "tr", "dt", "dd"):
                        close(k)
                        break
                    if name in BLOCK:
                        break
        if tag in VOID:
            continue
        parent = stack[-1] if stack else -1
        up = elements[parent] if stack else None
        in_article = bool(up and up.article)
        furniture = bool(up and up.furniture) or is_furniture(tag, m.group(3), in_article)
        elements.append(Element(tag, parent, furniture, in_article or tag == "article"))
        stack.append(len(elements) - 1)
        opened[tag] += 1
    flush()
    return Page(elements, blocks)
