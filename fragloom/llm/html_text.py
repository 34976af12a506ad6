"""Main text of web pages by two passes over their blocks.

Pass one decides blocks by link density, stop-word density and length, with the containers that
name their purpose (menus, footers, adverts ...) as further evidence.  What is short or middling
stays open.  Pass two gives every open block the label of its nearest decided neighbours, first
inside its own article, and an article in which nothing was decided is kept.
"""

import html
import re
from bisect import bisect_left

from pyspark.sql import DataFrame

from .rows import add_columns

# --- fixed values: element names, names of containers, common function words ---
BLOCKS = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section
    summary table tbody td tfoot th thead title tr ul""".split())
HIDDEN = set("script style noscript template textarea title iframe object svg math canvas select button audio video".split())
RAW = set("script style textarea title iframe noscript".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
AWAY = set("nav footer aside form menu dialog search".split())
MAIN = set("article main".split())
NAMES_AWAY = set("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie
    cookies copyright disclaimer disqus dropdown footer gdpr header login masthead menu modal nav navbar navigation newsletter
    notice pager pagination popup promo related reply respond search share sharing sidebar signup social sponsor sponsored
    subscribe tags toolbar widget""".split())
STOP_WORDS = set("""a about after all also an and any are as at be because been but by can could did do for from had has have he her
    him his how i if in into is it its more my no not of on one or our out said she so some than that the their them then there
    these they this to up was we were what when which who will with would you your
    aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer eines er es für hat
    haben ich im in ist ja kann man mehr mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn
    werden wie wir wird zu zum zur
    à au aux avec ce ces cette comme dans de des du elle en est et eux il ils je la le les leur leurs lui mais me même nous on ou
    où par pas plus pour qu que qui sa sans se ses son sont sur un une vous y
    al como con de del desde donde el ella en entre era es esta este ha hay la las lo los más me muy no nos o para pero por que
    se según ser si sin sobre son su sus también tan todo un una y ya
    che con da dal dei del della di e gli il le nel non per più sono sul una uno
    ao as com da das do dos em foi mais na nas no nos não os ou pela pelo por quando são um uma
    aan dat de een en er het hij ik in is maar met niet ook op te van voor was wat zijn""".split())
WITHOUT = set("has have no non not with without".split())
# --- end of fixed values ---

SHORT, LONG = 70, 200
MANY_LINKS, FEW_STOPS, MANY_STOPS = 0.33, 0.12, 0.25
GOOD, BAD, OPEN = 1, 0, None
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)
    |<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<rest>(?>"[^"]*"|'[^']*'|[^>"'])*+)(?:>|\Z)|<(?P<broken>/?[A-Za-z][^>]*+)(?:>|\Z)""", re.S | re.X)
NAMED = re.compile(r"""(?:\s|^)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[^\W\d_]+")


class _Closers:
    """Where the end tags of an element stand: listed once for each name, so a search is no walk over the page."""

    def __init__(self, page: str):
        self.page, self.known = page, {}

    def after(self, name: str, at: int):
        """End of the first end tag from `at` on, None without one."""
        if name not in self.known:
            found = re.compile(rf"</{re.escape(name)}\b[^>]*+(?:>|\Z)", re.I).finditer(self.page)
            self.known[name] = list(zip(*[(m.start(), m.end()) for m in found])) or [(), ()]
        starts, ends = self.known[name]
        i = bisect_left(starts, at)
        return ends[i] if i < len(starts) else None


def blocks(page: str) -> tuple:
    """((text, characters in links, element, away, article, hint) in page order, outer); empty blocks are left out.

    away: inside an element that holds no main text; article: number of the innermost article, 0 if
    none; hint: number of the innermost container whose class, id or role names a purpose other than
    the main text, 0 if none since the innermost article; outer: the hint around each hint.
    """
    out, text, linked = [], [], 0
    stack, opened = [], {}  # open containers: (name, away, article, hint); how many of each name
    outer, closers = [0], _Closers(page)
    link, seen = 0, 0
    at, element = 0, ""

    def flush():
        nonlocal text, linked
        whole = " ".join("".join(text).split())
        if whole:
            out.append((whole, linked, element, *(stack[-1][1:] if stack else (False, 0, 0))))
        text, linked = [], 0

    def add(raw):
        nonlocal linked
        plain = html.unescape(raw) if "&" in raw else raw
        text.append(plain)
        if link:
            linked += len("".join(plain.split()))

    for m in TAG.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        if m["broken"]:
            continue
        name = (m["name"] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:-3])
            continue
        if m["end"]:
            if name == "a":
                link = max(0, link - 1)
            elif name in BLOCKS:
                flush()
                while opened.get(name):  # what stands open inside it ends with it
                    last = stack.pop()[0]
                    opened[last] -= 1
                    if last == name:
                        break
                element, link = "", 0
            continue
        if name in HIDDEN:
            end = None if (m["rest"] or "").endswith("/") else closers.after(name, at)
            if end is not None:
                at = end
            elif name in RAW and not (m["rest"] or "").endswith("/"):
                at = len(page)
            text.append(" ")
            continue
        if name == "br" or name == "img" or name == "input":
            text.append(" ")
        elif name == "a":
            link += 1
        elif name in BLOCKS:
            flush()
            element, link = name, 0
            if name not in VOID and name not in ("p", "li", "td", "th", "tr", "dd", "dt", "option", "html", "body", "head"):
                away, art, hint = stack[-1][1:] if stack else (False, 0, 0)
                if name in MAIN:  # a wrapper's name says nothing on an article inside it
                    seen += 1
                    art, hint = seen, 0
                elif _named_away(m["rest"], art):
                    outer.append(hint)
                    hint = len(outer) - 1
                stack.append((name, away or name in AWAY or (name == "header" and not art), art, hint))
                opened[name] = opened.get(name, 0) + 1
    if at < len(page):
        add(page[at:])
    flush()
    return out, outer


def _named_away(attributes: str, inside) -> bool:
    for m in NAMED.finditer(attributes or ""):
        words = set()
        for one in (m[1] or m[2] or m[3] or "").lower().split():
            parts = re.split(r"[^a-z0-9]+", one)
            if not WITHOUT & set(parts):  # "has-sidebar" and "no-comments" tell of something else on the page
                words |= set(parts)
        if words & NAMES_AWAY and not (inside and words & NAMES_AWAY <= {"header"}):
            return True
    return False


def _dense(text: str) -> bool:
    found = WORD.findall(text.lower())
    return len(text) >= LONG and sum(w in STOP_WORDS for w in found) >= MANY_STOPS * max(1, len(found))


def condemned(found: list, outer: list) -> list:
    """Which hints condemn what they hold.

    A hint is evidence only: on a page without an article it is void where most of the page's dense
    text stands below it, as it then wraps the main text.  One hint that holds condemns all inside it.
    """
    weight = [0] * len(outer)
    for text, linked, _, away, article, hint in found:
        if not away and not article and linked <= MANY_LINKS * len(text) and _dense(text):
            weight[hint] += len(text)
    articles = any(b[4] and not b[3] for b in found)
    for i in range(len(outer) - 1, 0, -1):  # a hint has a smaller number than those inside it
        weight[outer[i]] += weight[i]
    out = [False] * len(outer)
    for i in range(1, len(outer)):
        out[i] = out[outer[i]] or articles or not weight[i] > weight[0] / 2
    return out


def decide(block: tuple, hinted: bool, articles: bool):
    """Pass one: good, bad or open.  articles: the page marks its article, so text beside it needs stop words."""
    text, linked, _, away, article, _ = block
    solid = len(text) - text.count(" ")
    if away or hinted or linked > MANY_LINKS * solid:
        return BAD
    if len(text) < SHORT:
        return OPEN
    found = WORD.findall(text.lower())
    density = sum(w in STOP_WORDS for w in found) / max(1, len(found))
    if density >= MANY_STOPS and len(text) >= LONG:
        return GOOD
    return OPEN if density >= FEW_STOPS or article or not articles else BAD


def settle(found: list, labels: list) -> list:
    """Pass two: open blocks take the label of the nearest decided neighbours."""
    n = len(found)
    before, after = [None] * n, [None] * n
    for order, near in ((range(n), before), (range(n - 1, -1, -1), after)):
        last = {}
        for i in order:
            near[i] = (last.get(found[i][4]), last.get(None))
            if labels[i] is not OPEN:
                last[found[i][4]] = last[None] = i
    out = list(labels)
    for i in range(n):
        if labels[i] is not OPEN:
            continue
        inside = found[i][4]
        if inside:  # neighbours that are bad for what they are say nothing on an article's own text
            sides = [j for j in (before[i][0], after[i][0]) if j is not None and labels[j] == GOOD]
            out[i] = GOOD if sides or not found[i][3] else BAD
            continue
        sides = [j for j in (before[i][1], after[i][1]) if j is not None]
        if not sides:
            out[i] = GOOD
            continue
        heading = re.fullmatch(r"h[1-6]", found[i][2] or "")
        if heading and after[i][1] is not None:
            out[i] = labels[after[i][1]]
            continue
        nearest = min(abs(j - i) for j in sides)
        closest = {labels[j] for j in sides if abs(j - i) == nearest}
        out[i] = GOOD if closest == {GOOD} or (GOOD in closest and len(found[i][0]) >= SHORT) else BAD
    return out


def main_text(page: str) -> str:
    found, outer = blocks(page or "")
    bad, articles = condemned(found, outer), any(b[4] for b in found)
    labels = settle(found, [decide(b, bad[b[5]], articles) for b in found])
    return "\n".join(b[0] for b, good in zip(found, labels) if good)


def extract(df: DataFrame, html: str = "html", name: str = "text", keep: list = None) -> DataFrame:
    """Adds the main text of every whole page; no shuffle.

    Null and empty pages give an empty text.  Pages are read whole, in time in proportion to their
    length, however their tags nest.  Repeated rows stay.  An empty table gives no rows.  A column
    named like the result is replaced; any other names may be used.
    """
    def start():
        return lambda pages: [[main_text(p) for p in pages]]

    return add_columns(df, [html], [(name, "string")], start, keep)
