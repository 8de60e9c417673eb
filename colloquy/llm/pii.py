"""Personal data: fixed base patterns, and more spans by a semi-Markov conditional random field.

Base spans are those of the fixed patterns (email, ip, card, phone); they always stay. The field works on
windows of tokens around digits, at signs and written-out ones ("joe at x.org"): a segment of at most ``LONGEST`` tokens is
scored as a whole (its digits, signs, shape, check digit, what stands before and after it, cue words) for each kind, tokens
outside of entities score 0, and dynamic programming chooses boundaries and kinds jointly. Segments
that would touch a base span are left out, so the field only adds spans: local telephone numbers, cards in
groups of other signs, masked addresses. A candidate has at most ``LONGEST`` tokens and ``REACH`` characters and no white space but
single spaces; windows of any length are searched whole.

The field is fitted on the driver: at most ``most`` windows of at most ``longest`` tokens of at most ``sample`` documents with digits, at
signs or "at" before a host, lowest hashes first, with the base spans as entities and all else as none, and ``made`` sentences of words of these
documents with invented entities in many formats, or with what looks like them: people and things "at" a site, numbers of orders, pages and parcels,
coordinates, ratios, bank accounts, dates, amounts, versions, times. So a shape alone doesn't decide: "name at host" needs a name-like
left side or a word such as "mail" before it, digits in groups of blanks a word such as "call". Every text is searched, whole.

Cases: null and empty texts have no spans; repeated rows and ids stay rows of their own; an empty table gives no rows; other
columns are ignored. Positions are code points, ends exclusive. Spans of one kind don't overlap;
base spans of different kinds may. Of segmentations with equal scores the one that leaves its last
token out counts, then the one whose last span begins first.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lowest

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: The base patterns (fixed values). A run of digits is entered at its start only: an inner start
#: fails where the first one fails.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What a candidate has: a digit, an at sign, or "at" between what may be a name and a host.
HINT = re.compile(r"[0-9@aA](?:(?<=[0-9@])|(?<=[\w ][ (\[][aA])[tT](?=[ )\]] ?[A-Za-z0-9-]+(?:\.| (?:dot|DOT) | ?[\[(](?:dot|DOT|\.)[\])] ?)[A-Za-z0-9]))")
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\s\w]|_|\S")
LONGEST = 16
#: Most characters of a candidate; tokens that are scored at a time.
REACH = 64
BLOCK = 400
CLEAR = 1.0

Span = tuple[int, int]


def digits_of(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def luhn(s: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits_of(s))):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def octets(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def base_spans(text: str) -> dict[str, list[Span]]:
    """Spans by kind, in order, of a text."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    if not HINT.search(text):
        return found
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found["email"].append((start, end))
        at = text.find("@", max(at + 1, end))
    found["ip"] = [m.span() for m in IP.finditer(text) if octets(m.group())]
    found["card"] = [m.span() for m in CARD.finditer(text) if 13 <= len(digits_of(m.group())) <= 19 and luhn(m.group())]
    if "+" in text:
        found["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return found


def bucket(n: int, bounds: tuple[int, ...]) -> int:
    return sum(n >= b for b in bounds)


#: Words before an entity that tell of its kind, or that a number or place follows which is none (fixed values), and how far before it they are looked for.
CUES = {
    "email": ("mail", "e-mail", "contact", "write to", "reach", "send"),
    "ip": ("ip", "host", "server", "address", "ping"),
    "card": ("card", "visa", "credit", "account", "mastercard", "amex"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "cell", "dial", "whatsapp", "text me", "ring"),
}
NO_CUES = (
    "order", "invoice", "ratio", "coordinates", "page", "pages", "part", "item", "serial", "ticket", "case", "iban", "isbn", "id", "ref", "reference", "version", "build", "room", "model",
    "article", "lot", "sku", "tracking", "score", "figure", "table", "line", "number of", "sequence", "code", "range", "size", "section", "chapter", "volume", "issue", "grid", "batch", "parcel", "population", "total",
)
#: Words that stand before "at" in prose and are no names (fixed values); those that end in -ing or -ed count as such.
ORDINARY = frozenset(
    """i me my you your he him his she her it its we us our they them their who someone anyone everyone nobody people team staff all both each one ones
    this that these those here there now today tonight tomorrow yesterday always only also more most less much data code docs page pages site sites website blog news list lists
    file files version stuff work works look looks talk talks live lives stay stays sell sells buy shop store start starts end ends read write reads see saw seen sit sat met meet meets meeting
    be is are was were been am not up down out over back home school lunch noon night event events conference office class course job jobs find found get got made sold held run ran runs
    available online free open new best good hosts host server servers service services product products tickets information details info help support support order orders shown written taught won lost""".split()
)
CUE_REACH = 16
CUE = [re.compile(r"\b(?:" + "|".join(words) + r")", re.I) for words in CUES.values()]
NO_CUE = re.compile(r"\b(?:" + "|".join(NO_CUES) + r")\b[ #:.no]*$", re.I)
#: "local at host" in its parts: sign or word, host.
AT = re.compile(r"([A-Za-z0-9._%+-]*[A-Za-z0-9])( at | @ |@| ?[\[(] ?(?:at|@) ?[\])] ?)(.+[A-Za-z])", re.I)
NANP = re.compile(r"(?:\+?1[ .-]?)?\(?[2-9][0-9]{2}\)?[ .-]?[2-9][0-9]{2}[ .-]?[0-9]{4}")
#: Whole shapes of spans: telephone numbers, cards, addresses, and what is none of these.
SHAPES = [
    re.compile(p, re.I)
    for p in (
        r"(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}",
        r"(?:\+|00)[1-9][0-9]{0,2}(?:[ ./-]\(?[0-9]+\)?)+",
        r"\(?0[1-9][0-9]{1,4}\)?(?:[ /.-][0-9]{2,})+",
        r"0[0-9](?:[ .-][0-9]{2}){4}",
        r"[0-9]{4}(?:([ ./-])[0-9]{4})(?:\1[0-9]{4}){2}|[0-9]{4}([ ./-])[0-9]{6}\2[0-9]{5}",
        r"[0-9]{1,3}(?: ?[\[(](?:dot|\.)[\])] ?[0-9]{1,3}){3}|[0-9]{1,3}(?: dot [0-9]{1,3}){3}",
        r"[a-z0-9._%+-]+(?: ?[\[(] ?(?:at|@) ?[\])] ?| at | @ |@)[a-z0-9-]+(?:(?:\.| dot | ?[\[(](?:dot|\.)[\])] ?)[a-z0-9-]+)+",
        r"(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{2,4})(?: .*)?",
        r"v?[0-9]{1,3}(?:[.:][0-9]{1,3}){1,2}",
        r"[0-9]{1,3}(?:[,. ][0-9]{3})+(?:[.,][0-9]{1,2})?",
        r"[0-9]{3,4}-[0-9]{2,4}",
        r"[0-9a-f]{2,}(?:[:-][0-9a-f]{2,})+",
    )
]
OTHER_SIGNS = re.compile(r"[^0-9A-Za-z@._%+() \[\]/-]")


def features(text: str, start: int, end: int) -> list[int]:
    """Indexes of the features that a whole candidate span has (of N_FEATURES)."""
    s = text[start:end]
    digits = digits_of(s)
    n = len(digits)
    before = text[start - 1] if start else " "
    after = text[end] if end < len(text) else " "
    follows = text[end + 1] if end + 1 < len(text) else " "
    letters = any(c.isalpha() for c in s)
    rest = re.sub(r"[0-9]", "", s)
    tests = (
        s[0] == "+",
        s[0] == "(",
        "@" in s[1:-1],
        "@" in s and "." in s[s.index("@") :],
        letters,
        letters and n > 0 and "@" not in s,
        not letters and 13 <= n <= 19 and luhn(s),
        not letters and s.count(".") == 3 and not rest.strip(".") and octets(s),
        " " in s,
        "-" in s,
        "(" in s and ")" in s,
        ("(" in s) != (")" in s) or ("[" in s) != ("]" in s),
        not rest,
        before.isalnum() or before in "=_\"'/",
        after.isalnum() or after in "=_\"'/",
        before in "+.@-:$€£#" or after in "@-:%",
        after in ".," and follows.isalnum(),
        OTHER_SIGNS.search(s) is not None,
        s[-1] in ".,-)" or s[0] in ".,-)",
        "\n" in s or "\t" in s,
        n > 0 and not letters and len({c for c in rest}) > 3,
        # a group of digits goes on before or behind it
        before in " .-/" and start > 1 and text[start - 2].isdigit(),
        after in " -/." and follows.isdigit(),
        before == " " and start > 2 and text[start - 2].isdigit() and text[start - 3].isupper(),
        not letters and NANP.fullmatch(s) is not None,
        n > 0 and not rest.strip(" "),
    )
    out = [0, 1 + bucket(n, (1, 7, 9, 12, 13, 20)), 8 + bucket(s.count("."), (1, 2, 3, 4)), 13 + bucket(len(s), (7, 12, 20, 32))]
    out += [18 + i for i, t in enumerate(tests) if t]
    at = 18 + N_TESTS
    fits = [at + i for i, shape in enumerate(SHAPES) if shape.fullmatch(s)]
    out += fits or [at + len(SHAPES)]
    at += len(SHAPES) + 1
    near = text[max(0, start - CUE_REACH) : start]
    # cue words count beside a shape
    cues = [i for i, cue in enumerate(CUE) if cue.search(near)]
    out += [at + i + len(CUE) * bool(fits) for i in cues]
    parts = AT.fullmatch(s) if letters else None
    bare = parts is not None and parts[2] == " at " and not DOT.search(parts[3])
    # "name at host" and numbers in groups of blanks need more than their shape
    out += [at + 2 * len(CUE) + i for i in cues if bare or (fits and not letters and not rest.strip(" "))]
    at += 3 * len(CUE)
    if 13 <= n <= 19 and not letters:
        out.append(at + luhn(s))
    at += 2
    if parts:
        local = parts[1]
        plain = local.isalpha()
        common = plain and (local.lower() in ORDINARY or local.lower().endswith(("ing", "ed")))
        tests = (bare, bare and plain, bare and common, bare and not plain, not bare and parts[2] != " at ", DOT.search(parts[3]) is not None, parts[3].lower().startswith("www"), bare and plain and not common and 0 in cues)
        out += [at + i for i, t in enumerate(tests) if t]
    elif letters and not DOT.search(s):
        out.append(at + N_AT - 1)
    at += N_AT
    numbered = NO_CUE.search(near) is not None
    out += [at + i for i, t in enumerate((numbered, numbered and bool(fits), bool(fits) and not cues and not numbered)) if t]
    return out


#: A dot that is written out.
DOT = re.compile(r" dot | ?[\[(](?:dot|\.)[\])]", re.I)


N_TESTS, N_AT = 26, 9
N_FEATURES = 18 + N_TESTS + len(SHAPES) + 1 + 3 * len(CUES) + 2 + N_AT + 3


def hinted(text: str, start: int, end: int) -> bool:
    """Whether a token has a digit, is an at sign or stands for one."""
    return text[start].isdigit() or HINT.match(text, start) is not None


def windows(text: str) -> Iterator[list[Span]]:
    """Token spans around digits and at signs. No candidate crosses from a window to the next: they are more than REACH apart from
    each other's digits and signs or, after BLOCK tokens, end at white space of two characters or more."""
    done = 0
    for m in HINT.finditer(text):
        if m.start() < done:
            continue
        tokens, last = [], m.start()
        for t in TOKEN.finditer(text, max(done, m.start() - REACH)):
            if t.start() > last + 2 * REACH or (len(tokens) >= BLOCK and t.start() - tokens[-1][1] > 1):
                break
            tokens.append(t.span())
            if HINT.search(t.group()) or HINT.match(text, t.start()):
                last = t.end()
        while tokens[-1][0] > last + REACH:
            tokens.pop()
        done = tokens[-1][1]
        yield tokens


def candidates(text: str, tokens: list[Span], taken: list[Span], most: int | None = None) -> list[tuple[int, int]]:
    """Token ranges that may be entities, of the first ``most`` starts: with a digit or at sign, clear of ``taken`` (in order), no white space but single spaces."""
    hint = [hinted(text, a, b) for a, b in tokens]
    first, until = [x for x, _ in taken], [0, *accumulate((y for _, y in taken), max)]
    free = [until[bisect_left(first, b)] <= a for a, b in tokens]
    out = []
    for i, (a, _) in enumerate(tokens[:most]):
        if not free[i] or not (text[a].isalnum() or text[a] in "+("):
            continue
        any_hint = False
        for j in range(i, min(i + LONGEST, len(tokens))):
            if not free[j] or (j > i and tokens[j][0] - tokens[j - 1][1] > 1) or (tokens[j][1] - a > REACH):
                break
            any_hint = any_hint or hint[j]
            if any_hint and text[tokens[j][1] - 1].isalnum():
                out.append((i, j + 1))
    return out


def best_segments(n: int, ranges: list[tuple[int, int]], scores: np.ndarray) -> list[tuple[int, int, int]]:
    """Viterbi over segmentations of n tokens: chosen (start, end, kind)."""
    return best_of_blocks(n, [(ranges, scores)])


def best_of_blocks(n: int, blocks: Iterable[tuple[list[tuple[int, int]], np.ndarray]]) -> list[tuple[int, int, int]]:
    """best_segments() of ranges that come in blocks, by start; for each end only the best one is kept."""
    best, start, kinds = [0.0] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
    at = 0

    def move(to: int) -> None:
        """Makes best[: to + 1] final: leaving a token out counts 0."""
        nonlocal at
        for j in range(at + 1, to + 1):
            if start[j] < 0 or best[j] <= best[j - 1]:
                best[j], start[j] = best[j - 1], -1
        at = max(at, to)

    for ranges, scores in blocks:
        for (i, j), kind, score in zip(ranges, scores.argmax(1).tolist(), scores.max(1).tolist(), strict=True):
            move(i)
            value = best[i] + score
            if start[j] < 0 or value > best[j]:
                best[j], start[j], kinds[j] = value, i, kind
    move(n)
    out, j = [], n
    while j > 0:
        if start[j] < 0:
            j -= 1
        else:
            out.append((start[j], j, kinds[j]))
            j = start[j]
    return out[::-1]


def expected(n: int, ranges: list[tuple[int, int]], scores: np.ndarray) -> np.ndarray:
    """Probability of each (candidate, kind) over all segmentations, by forward-backward in logarithms."""
    each = np.logaddexp.reduce(scores, axis=1)
    ending: dict[int, list[int]] = {}
    starting: dict[int, list[int]] = {}
    for c, (i, j) in enumerate(ranges):
        ending.setdefault(j, []).append(c)
        starting.setdefault(i, []).append(c)
    ahead, back = np.zeros(n + 1), np.zeros(n + 1)
    for j in range(1, n + 1):
        ahead[j] = np.logaddexp.reduce([ahead[j - 1], *(ahead[ranges[c][0]] + each[c] for c in ending.get(j, ()))])
    for i in range(n - 1, -1, -1):
        back[i] = np.logaddexp.reduce([back[i + 1], *(back[ranges[c][1]] + each[c] for c in starting.get(i, ()))])
    return np.exp(scores + np.array([ahead[i] + back[j] - ahead[n] for i, j in ranges])[:, None])


def design(text: str, tokens: list[Span], ranges: list[tuple[int, int]]) -> np.ndarray:
    x = np.zeros((len(ranges), N_FEATURES))
    for c, (i, j) in enumerate(ranges):
        x[c, features(text, tokens[i][0], tokens[j - 1][1])] = 1
    return x


def invented(random: np.random.Generator) -> tuple[str, str, str | None]:
    """Words before it, an entity in one of its formats and its kind, or something that is none."""
    d = lambda n: "".join(map(str, random.integers(0, 10, n)))
    pick = lambda *xs: xs[int(random.integers(len(xs)))]
    cue = lambda kind: pick(*CUES[kind]) + pick(" ", ": ", " is ", " at ") if random.random() < 0.3 else ""
    name = lambda: "".join(map(chr, random.integers(97, 123, int(random.integers(2, 9)))))
    top = lambda: pick("com", "org", "net", "de", "io", "edu")
    area, line = f"{random.integers(2, 10)}{d(2)}", f"{random.integers(2, 10)}{d(2)}"
    kind = pick(*KINDS, *[None] * 4)
    if kind == "phone":
        if random.random() < 0.3:
            # in blanks alone or short: with a word that says so
            number = pick(f"{area} {line} {d(4)}", f"0{random.integers(20, 9999)} {d(int(random.integers(5, 9)))}", f"020 {d(4)} {d(4)}", f"{line}-{d(4)}", f"0{random.integers(10, 99)} {d(3)} {d(2)} {d(2)}")
            return pick(*CUES[kind]) + pick(" ", ": ", ". ", " me on ", " us at "), number, kind
        return (
            cue(kind),
            pick(
                f"+1 ({area}) {line}-{d(4)}", f"({area}) {line}-{d(4)}", f"({area}) {line} {d(4)}", f"{area}-{line}-{d(4)}", f"{area}.{line}.{d(4)}", f"1-{area}-{line}-{d(4)}",
                f"00{random.integers(30, 99)} {random.integers(10, 999)} {d(int(random.integers(5, 9)))}", f"+{random.integers(20, 99)} {random.integers(1, 999)} {d(int(random.integers(5, 9)))}", f"00{random.integers(30, 99)} {random.integers(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}",
                f"0{random.integers(20, 9999)}/{d(int(random.integers(5, 9)))}", f"0{random.integers(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{random.integers(1, 9)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"(0{random.integers(20, 999)}) {d(int(random.integers(6, 9)))}",
            ),
            kind,
        )
    if kind == "card":
        body = pick("4", "5", "37", "6")
        size = 15 if body == "37" else 16
        body += d(size - 1 - len(body))
        body += next(c for c in "0123456789" if luhn(body + c))
        sign = pick(" ", "-", ".", "/", "")
        cuts = (0, 4, 10, 15) if size == 15 else (0, 4, 8, 12, 16)
        return cue(kind), sign.join(body[x:y] for x, y in zip(cuts, cuts[1:])), kind
    if kind == "ip":
        return cue(kind), pick(".", ".", "[.]", "(.)", "[dot]", " dot ", "(dot)").join(str(random.integers(pick(10, 100, 256, 256))) for _ in range(4)), kind
    if kind == "email":
        handle = pick(f"{name()}.{name()}", f"{name()}{d(2)}", f"{name()}_{name()}", f"{name()}-{name()}")
        host = pick([name(), top()], [name(), name(), top()])
        if random.random() < 0.4:
            # "name at host": a handle, or a word that says so
            with_cue = random.random() < 0.6
            return (pick(*CUES[kind]) + pick(" ", ": ", " is ", " to ") if with_cue else "", (name() if with_cue and random.random() < 0.7 else handle) + " at " + ".".join(host), kind)
        local = pick(name(), handle, handle)
        return cue(kind), local + pick("@", "@", " @ ", "(at)", " (at) ", "[at]", " [at] ", " at ") + (pick(" dot ", "[dot]", " [dot] ", "(dot)", "[.]") if random.random() < 0.5 else ".").join(host), kind
    return (*no_entity(random, d, pick, name, top), None)


def no_entity(random: np.random.Generator, d, pick, name, top) -> tuple[str, str]:
    """Words before and a text that looks like an entity and is none."""
    year, month, day = random.integers(1900, 2100), random.integers(1, 13), random.integers(1, 29)
    other = d(15)
    other += next(c for c in "0123456789" if not luhn(other + c))
    which = random.random()
    if which < 0.35:
        # somebody or something at a site
        word = pick(*sorted(ORDINARY)) if random.random() < 0.6 else name() + pick("", "ing", "ed", "s")
        word = word.capitalize() if random.random() < 0.2 else word
        lead = pick("", "", "", "see ", "more ", "contact ", "reach ", "the ") if word.lower() in ORDINARY else pick("", "", "see ", "the ", "was ", "and ")
        return lead, f"{word} at {pick('', '', 'www.', 'docs.', 'shop.')}{name()}.{top()}"
    if which < 0.6:
        # numbers of other things
        word = pick(*NO_CUES, "") + pick(" ", " ", ": ", " no. ", " #")
        return word.strip() + " " if word.strip() else "", pick(
            f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"1{d(2)}-{d(3)}-{d(4)}", f"{d(3)}-1{d(2)}-{d(4)}", f"{d(3)}-{d(4)}", f"{d(2)}-{d(4)}-{d(4)}", f"0{d(2)} {d(3)} {d(3)}", f"{d(4)} {d(4)} {d(4)}", f"0{d(4)}", f"{d(4)}/{d(5)}", f"{d(2)}.{d(4)}, {d(2)}.{d(4)}",
        )
    if which < 0.7:
        # account numbers of banks, groups that go on
        return pick("", "IBAN ", "account "), pick("DE", "FR", "GB") + d(2) + " " + " ".join(d(4) for _ in range(int(random.integers(3, 5)))) + " " + d(int(random.integers(1, 4)))
    return pick("", "", "looking at ", "at ", "about "), pick(
        f"{year}-{month:02}-{day:02}", f"{day}.{month}.{year}", f"{month}/{day}/{year}", f"{year}-{month:02}-{day:02} {random.integers(24):02}:{d(2)}", f"{random.integers(24)}:{d(2)}", str(year), f"{year}-{year + 1}",
        f"v{random.integers(9)}.{random.integers(20)}.{random.integers(9)}", f"{random.integers(9)}.{random.integers(20)}", f"${random.integers(1000)}.{d(2)}", f"{random.integers(1, 999)},{d(3)},{d(3)}", f"{random.integers(1, 999)} {d(3)} {d(3)}",
        d(int(random.integers(1, 13))), other, f"{d(4)}-{d(4)}", f"#{d(6)}", f"{d(3)}-{d(2)}", f"{random.integers(100)}%", "token = \"" + "".join(pick(*"0123456789abcdef") for _ in range(40)) + '"', f"p. {d(3)}-{d(3)}", f"ISBN 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}",
        f"{d(1)}.{d(1)}", f"{random.integers(300, 999)}.{random.integers(300, 999)}.{d(3)}.{d(3)}", f"{random.integers(99)} x {random.integers(99)}", f"{d(2)}.{d(3)}.{d(3)}", f"{d(1)}.{d(2)}.{d(1)}.{d(4)}", f"{random.integers(24)}:{d(2)}:{d(2)}.{d(3)}",
    )


def sentences(texts: list[str], random: np.random.Generator, made: int) -> Iterator[tuple[str, dict[Span, int]]]:
    """Texts of a few words of ``texts`` around invented entities, and which spans are of which kind."""
    for _ in range(made):
        words = re.findall(r"[^\W\d_]+[.,;]?", texts[int(random.integers(len(texts)))][:4096]) if texts else []
        text, gold = "", {}
        for _ in range(int(random.integers(1, 3))):
            at = int(random.integers(len(words) + 1))
            text += "".join(w + " " for w in words[at : at + int(random.integers(0, 7))])
            lead, entity, kind = invented(random)
            text += lead
            if kind:
                gold[len(text), len(text) + len(entity)] = KINDS.index(kind)
            text += entity + (" ", ". ", ", ", "\n")[int(random.integers(4))]
        at = int(random.integers(len(words) + 1))
        text += " ".join(words[at : at + int(random.integers(0, 7))])
        yield text.strip(), gold


def fit_field(texts: list[str], passes: int = 6, rate: float = 0.3, most: int = 500, made: int = 2000, longest: int = 60) -> np.ndarray:
    """Weights (kinds x features) of greatest likelihood of texts' base spans and of ``made`` sentences' entities, by stochastic gradient.

    Of the texts, windows of at most ``longest`` tokens are learned from, until there are ``most`` of them.
    """
    weights = np.zeros((len(KINDS), N_FEATURES))
    weights[:, 0] = -4
    random = np.random.Generator(np.random.PCG64(9))
    data = []

    def learn(text: str, gold: dict[Span, int]) -> None:
        for tokens in windows(text):
            ranges = candidates(text, tokens, []) if len(tokens) <= longest else []
            if not ranges:
                continue
            y = np.zeros((len(ranges), len(KINDS)))
            for c, (i, j) in enumerate(ranges):
                kind = gold.get((tokens[i][0], tokens[j - 1][1]))
                if kind is not None:
                    y[c, kind] = 1
            data.append((len(tokens), ranges, design(text, tokens, ranges), y))

    for text in texts:
        learn(text, {span: k for k, spans in enumerate(base_spans(text).values()) for span in spans})
        if len(data) >= most:
            break
    for text, gold in sentences(texts, random, made):
        learn(text, gold)
    for p in range(passes):
        for d in random.permutation(len(data)).tolist():
            n, ranges, x, y = data[d]
            weights += rate / (1 + p) * ((y - expected(n, ranges, x @ weights.T)).T @ x) - rate / (1 + p) * 1e-4 * weights
    return weights


def field_spans(text: str, base: dict[str, list[Span]], weights: np.ndarray) -> list[tuple[int, int, str]]:
    """What the field adds: (start, end, kind) clear of the base spans."""
    taken = sorted(s for spans in base.values() for s in spans)
    first, until = [x for x, _ in taken], list(accumulate((y for _, y in taken), max))

    def scored(tokens: list[Span]) -> Iterator[tuple[list[tuple[int, int]], np.ndarray]]:
        for at in range(0, len(tokens), BLOCK):
            some = tokens[at : at + BLOCK + LONGEST - 1]
            ranges = candidates(text, some, taken[bisect_right(until, some[0][0]) : bisect_left(first, some[-1][1])], BLOCK)
            if ranges:
                yield [(at + i, at + j) for i, j in ranges], design(text, some, ranges) @ weights.T - CLEAR

    return [(tokens[i][0], tokens[j - 1][1], KINDS[k]) for tokens in windows(text) for i, j, k in best_of_blocks(len(tokens), scored(tokens))]


def written(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in sorted(spans[kind]))


def all_spans(text: str | None, weights: np.ndarray) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans and all spans of a text."""
    if not text or not HINT.search(text):
        return {k: [] for k in KINDS}, {k: [] for k in KINDS}
    base = base_spans(text)
    every = {k: list(v) for k, v in base.items()}
    for a, b, kind in field_spans(text, base, weights):
        every[kind].append((a, b))
    return base, every


def find_rows(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base, every = all_spans(text, weights)
                spans = written(every)
                rows.append((*(len(base[k]) for k in KINDS), written(base), spans, mask(text, spans)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 3
            names = [f"n_{k}" for k in KINDS] + ["base", "spans", "text"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", *names])

    return run


def mask_rows(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [mask(t, written(all_spans(t, weights)[1])) for t in batch.column("text").to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    return run


def fit_pii(docs: DataFrame, sample: int = 300, max_bytes: int = 1 << 15) -> np.ndarray:
    rows = docs.filter(F.col("text").rlike(r"[0-9@]|\w at [\w-]+\.\w") & (F.octet_length("text") <= max_bytes)).select("doc_id", "text")
    return fit_field([r.text for r in lowest(rows, "doc_id", "text", k=sample)])


def find_pii(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base and spans (all, written), text (masked) of every row of ``docs``."""
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", "text").mapInArrow(find_rows(weights), f"doc_id long, {counts}, base string, spans string, text string")


def mask(text: str | None, spans: str) -> str | None:
    """The text with each span (merged where they overlap) replaced by its first kind in angle brackets."""
    if not spans:
        return text
    parts, at = [], 0
    for a, b, kind in sorted((int(a), -int(b), k) for k, a, b in (s.split(":") for s in spans.split(","))):
        if a >= at:
            parts += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, -b)
    return "".join([*parts, text[at:]])


def mask_pii(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``docs`` with personal data in text masked."""
    return docs.mapInArrow(mask_rows(weights), docs.schema)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_pii(docs, fit_pii(docs))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "text")
