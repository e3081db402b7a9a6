"""Personal data: exact base patterns, and a character tagger that adds spans to them.

The tagger (bidirectional LSTM with CRF transitions) learns from windows whose spans the base patterns label, and
from respelled copies of their surroundings (a phone number without its country code, an address with a spelled or
spaced @ and spelled dots, an ip with bracketed or spelled dots, a card with dots or strokes), so that it finds spans that
the patterns can't.  It sees shapes: brackets of all sorts are alike, as are dashes and blanks of all sorts, a spelled at
has the shape of @ and a spelled dot that of a dot, so it also knows spellings that it never saw.  It is trained
for a fixed number of steps on at most GROUP distinct windows of each kind and form and PLAIN windows without a span,
chosen by hash among those of a sample of documents, and on a few made lines, so that it knows each form in a table of
any size.  A window with an unlabelled at, or an unlabelled number as long as a phone's, teaches nothing: it may well
be one of the spans to find.

Every kind of span has a digit, an @ or a spelled at, so windows are laid over the surroundings of these characters;
text without any can't hold a span.  Overlapping windows are decoded, and each character takes the tag of the window
in which it stands nearest the middle; spans are read off the reconciled tags.  A local part that doesn't fit beside
its @ is shown to the tagger without its middle, in training and in a second look of its own, so that its length
doesn't matter; an added address always takes the whole local part and domain.  A span is added if the tagger is sure
of all characters it saw, it passes its kind's test and it doesn't touch a base span or another added one.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columnar import emit, long, string, with_columns
from .tagger import Tagger

KINDS = ["email", "ip", "card", "phone"]
WINDOW, STRIDE, MARGIN = 64, 32, 16
#: Training windows: at most so many of each kind and form, and without a span.
GROUP, PLAIN = 150, 600
#: Documents that are looked at for training windows, on average at most.
TRAIN_DOCUMENTS = 30_000
#: Respelled copies of each labelled span, and the characters around it that they keep.
COPIES, AROUND = 8, 96
#: Spans of one document that are respelled.
RESPELLED = 20
STEPS = 700
SURE = 0.9
DECODE = 512
#: Windows of a text that are decoded and reconciled at a time, and those that two such stretches share.
STRETCH, OVERLAP = 4096, 64

#: The base patterns.  Possessive repeats only spare vain retries, the matches are the same.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[^0-9]+")
OPEN, SHUT, LABEL = r"[\[({<]", r"[\])}>]", "[A-Za-z0-9-]{1,63}"
#: A spelled at, which may go without brackets before a domain whose dots are spelled without them, and a spelled dot; in
#: "at the dot" the dot is a dot.
BARE_AT = f" [aA][tT] (?!(?:an?|the|this|that|each|every|one) )(?={LABEL} [dD][oO][tT] [A-Za-z0-9])"
BRACKETED_AT = f"{OPEN} ?(?:@|[aA][tT]) ?{SHUT}"
SPELLED_DOT = f"(?: ?{OPEN} ?(?:\\.|[dD][oO][tT]) ?{SHUT} ?| [dD][oO][tT] )"
EVIDENCE = re.compile(f"[0-9@]|{BRACKETED_AT}|{BARE_AT}")
AT = re.compile(f" ?(?:@|{BRACKETED_AT})|{BARE_AT}")
DOT = re.compile(SPELLED_DOT)
DOMAIN_REST = re.compile(rf"[A-Za-z0-9-]*(?:(?:\.|{SPELLED_DOT})[A-Za-z0-9-]+)*")
ADDRESS = re.compile(rf"[A-Za-z0-9._%+-]+(?: ?(?:@|{BRACKETED_AT}) ?|{BARE_AT})[A-Za-z0-9-]+(?:(?:\.|{SPELLED_DOT})[A-Za-z0-9-]+)+")
#: No spelled at or dot, with the characters that it needs to follow, is longer.
SPELLED = 96
#: Numbers that may be personal data in a spelling of their own.
NUMBER = re.compile(rf"[0-9]++(?:(?:{SPELLED_DOT}|[ ().\[\]-]{{1,3}})[0-9]++)+")
#: Of a longer local part, the tagger sees so many characters at its begin and end.
HEAD, TAIL = 4, 8


def luhn(digits: str) -> bool:
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def passes(kind: str, found: str) -> bool:
    """The test that a match of a kind's pattern has to pass."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in found.split("."))
    digits = DIGITS.sub("", found)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 8 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all base matches, sorted; offsets are code points."""
    out = []
    done = 0
    for m in DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            out.append((0, start, m.end()))
            done = m.end()
    for k, pattern in ((1, IP), (2, CARD), (3, PHONE)):
        out += [(k, m.start(), m.end()) for m in pattern.finditer(text) if passes(KINDS[k], m[0])]
    return sorted(out)


def shape_table() -> np.ndarray:
    """Shape of each code point below TABLE; all others have the shape of a letter."""
    own = {c: i + 6 for i, c in enumerate("@.-+()_%:/,\"=")}
    own |= dict.fromkeys("[{<", own["("]) | dict.fromkeys("]}>", own[")"])
    own |= dict.fromkeys(map(chr, range(0x2010, 0x2016)), own["-"])
    blank = {9, 10, 11, 12, 13, 32, 0xA0, *range(0x2000, 0x200B), 0x202F}
    return np.array([own.get(chr(c), 1 if 48 <= c < 58 else 3 if 65 <= c < 91 else 4 if c in blank else 2 if 97 <= c < 123 or c >= 128 else 5) for c in range(TABLE)])


TABLE = 0x2030
SHAPES = shape_table()
N_SHAPES = int(SHAPES.max()) + 1  # 0 is beyond the text
TAGS = 1 + 2 * len(KINDS)


def shapes_of(text: str) -> np.ndarray:
    """Shape of each character; the letters of a spelled at or dot have the shape of what they spell."""
    text = AT.sub(lambda m: re.sub("[A-Za-z]", "@", m[0]), text)
    text = DOT.sub(lambda m: re.sub("[A-Za-z]", ".", m[0]), text)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(code < TABLE, SHAPES[np.minimum(code, TABLE - 1)], 2)


def window_starts(text: str) -> list[int]:
    """Starts of the windows over the surroundings of all evidence."""
    out: list[int] = []
    low = high = -1
    for m in [*EVIDENCE.finditer(text), None]:
        if m and high >= 0 and m.start() - MARGIN <= high:
            high = m.end() + MARGIN
            continue
        if high >= 0:
            out += range(low, max(low + 1, high - WINDOW + STRIDE), STRIDE)
        if m:
            low, high = m.start() - MARGIN, m.end() + MARGIN
    return out


def local_start(text: str, at: int) -> int:
    """Where the run of local characters that ends before a place begins."""
    while at > 0 and text[at - 1] in LOCAL:
        at -= 1
    return at


def without_middles(text: str) -> np.ndarray | None:
    """The places of text that stay when long local parts lose their middle; None if there is none."""
    gaps = [(start + HEAD, m.start() - TAIL) for m in AT.finditer(text) if m.start() - (start := local_start(text, m.start())) > HEAD + TAIL]
    if not gaps:
        return None
    stays = np.ones(len(text), bool)
    for a, b in gaps:
        stays[a:b] = False
    return np.flatnonzero(stays)


def view(text: str, places: np.ndarray) -> str:
    """The characters of text at these places."""
    cuts = np.flatnonzero(np.diff(places) > 1).tolist()
    return "".join(text[places[a] : places[b] + 1] for a, b in zip([0, *(c + 1 for c in cuts)], [*cuts, len(places) - 1], strict=True))


def whole_address(text: str, a: int, b: int) -> tuple[int, int]:
    """A span with the local characters left of it and the rest of its domain, if it has an at."""
    at = AT.search(text, a, b + SPELLED)
    if not at or at.end() > b:
        return a, b
    return local_start(text, min(a, at.start())), DOMAIN_REST.match(text, at.end() + (text[at.end() : at.end() + 1] == " ")).end()


def cut(shapes: np.ndarray, starts: list[int]) -> np.ndarray:
    padded = np.concatenate([np.zeros(WINDOW, np.int64), shapes, np.zeros(2 * WINDOW, np.int64)])
    return padded[np.array(starts)[:, None] + WINDOW + np.arange(WINDOW)]


def tags_of(length: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """O, or the begin or inside tag of a span, for each character; of touching spans the first kind stays."""
    out = np.zeros(length, np.int64)
    for k, a, b in spans:
        if not out[a:b].any():
            out[a:b], out[a] = 2 + 2 * k, 1 + 2 * k
    return out


def digits_like(form: str, r: random.Random) -> str:
    """The form with other digits."""
    return re.sub("[0-9]", lambda _: str(r.randrange(10)), form)


def word(r: random.Random, low: int = 2, high: int = 9) -> str:
    return "".join(r.choice("aeinorstlu") for _ in range(r.randint(low, high)))


#: How people write an address's at and dots, and what stands between the groups of a number.
SPELLED_AT = ((" @ ", "."), (" [at] ", "."), ("(at)", "."), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" at ", " dot "), (" [ at ] ", "."), (" at ", " dot "))
SPELLED_IP = ("[.]", "[.]", "[dot]", " dot ", " [.] ")
PARTED = (" ", "-", ") ", ".")
CARD_PARTED = (".", "/", " - ", "  ", "-")


def respelled(kind: str, form: str, turn: int, r: random.Random) -> str:
    """The form of a span in another spelling that people use; the turn chooses it."""
    if kind == "email":
        local, domain = form.split("@")
        if turn % 2:
            local = r.choice((word(r), word(r) + str(r.randrange(1000)), f"{word(r)}.{word(r)}", f"{word(r)}_{word(r)}{r.randrange(100)}", f"{word(r, 1, 1)}.{word(r)}-{word(r)}"))
            domain = r.choice((domain, f"{word(r)}{r.randrange(30)}.{word(r)}.{word(r, 2, 3)}", f"{word(r)}.{word(r, 2, 3)}", f"{word(r)}-{word(r)}.{word(r, 2, 3)}"))
        at, dot = SPELLED_AT[turn % len(SPELLED_AT)]
        return local + at + domain.replace(".", dot)
    if kind == "ip":
        dot = SPELLED_IP[turn % len(SPELLED_IP)]
        return (dot if turn else ".").join(str(r.randrange(256)) for _ in range(3)) + f"{dot}{r.randrange(256)}"
    if kind == "card":
        return digits_like(CARD_PARTED[turn % len(CARD_PARTED)].join(re.findall("[0-9]{4}", DIGITS.sub("", form))), r)
    gap = PARTED[turn % len(PARTED)]
    head, mid, tail = (str(r.randrange(10 ** (n - 1), 10**n)) for n in (r.choice((3, 3, 4)), r.choice((3, 3, 4)), 4))
    return f"{'(' * (gap == ') ')}{head}{gap}{mid}{r.choice((' ', '-', '.')) if gap == ') ' else gap}{tail}"


def copies(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, str, list[tuple[int, int, int]]]]:
    """(turn, surroundings, spans in them) of respelled copies of spans: of all, or about RESPELLED spread over the text."""
    out, owned = [], np.zeros(len(text), np.int64)
    for _, a, b in spans:
        owned[a:b] += 1
    for k, a, b in spans[:: max(1, len(spans) // RESPELLED)]:
        if owned[a:b].max() > 1:  # spans that overlap aren't respelled
            continue
        left, right = np.flatnonzero(owned[max(0, a - AROUND) : a]), np.flatnonzero(owned[b : b + AROUND])
        low = max(0, a - AROUND) + (int(left[-1]) + 1 if len(left) else 0)
        high = b + int(right[0]) if len(right) else min(len(text), b + AROUND)
        r = random.Random(zlib.crc32(text[low:high].encode()))
        for turn in range(COPIES):
            form = respelled(KINDS[k], text[a:b], turn, r)
            out.append((turn, text[low:a] + form + text[b:high], [(k, a - low, a - low + len(form))]))
    return out


def made_lines(n: int = 40) -> list[str]:
    """Invented lines with a span of each kind, among words and numbers."""
    r, out = random.Random(5), []
    some = lambda: " ".join(word(r) if r.random() < 0.9 else str(r.randrange(10 ** r.randint(1, 9))) for _ in range(r.randint(2, 14)))
    for _ in range(n):
        for span in (f"{word(r)}.{word(r)}@{word(r)}.example.org", f"{r.randrange(256)}.{r.randrange(256)}.{r.randrange(256)}.{r.randrange(256)}", "4242 4242 4242 4242", f"+{r.randrange(1, 100)} {r.randrange(100, 1000)} {r.randrange(10**6, 10**7)}"):
            out.append(f"{some()} {span}{r.choice((' ', '. ', ', '))}{some()}")
    return out


def doubtful(text: str, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each character belongs to what may be personal data without a label."""
    out = np.zeros(len(text), bool)
    for m in AT.finditer(text):
        out[max(0, m.start() - 1) : m.end() + 1] = True
    for m in NUMBER.finditer(text):
        out[m.start() : m.end()] |= 10 <= len(DIGITS.sub("", m[0])) <= 19 or bool(DOT.search(m[0]))
    for _, a, b in spans:
        out[a:b] = False
    return out


def labelled(body: str) -> list[tuple[str, bytes]]:
    """(group, tags and shapes) of the windows of a text and of its respelled copies, without doubtful ones."""
    spans, rows = base_spans(body), []
    for turn, version, labels in [(-1, body, spans), *copies(body, spans)]:
        tags, doubt, places = tags_of(len(version), labels), doubtful(version, labels), without_middles(version)
        if places is not None:
            version, tags, doubt = view(version, places), tags[places], doubt[places]
        starts = window_starts(version)
        if starts:
            certain = ~cut(doubt, starts).any(axis=1)
            both = np.stack([cut(tags, starts), cut(shapes_of(version), starts)], axis=1).astype(np.uint8)
            for w in both[certain]:
                seen = w[0][w[0] > 0]
                if len(seen) or turn < 0:
                    rows.append((f"{KINDS[(seen[0] - 1) // 2]} {turn}" if len(seen) else "", w.tobytes()))
    return rows


def training_windows(df: DataFrame, text: str, group: int = GROUP, plain: int = PLAIN) -> tuple[np.ndarray, np.ndarray]:
    """Shapes and tags of distinct windows of a hash sample of the documents: at most so many of each kind and form,
    and without a span; then those of the made lines."""

    def kernel():
        def work(part: pa.RecordBatch):
            rows = sorted({row for body in part.column(0).to_pylist() for row in labelled(body)})
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in rows], pa.string()), pa.array([w for _, w in rows], pa.binary())], names=["form", "w"])

        return work

    share = min(1.0, TRAIN_DOCUMENTS / max(1, df.count()))
    chosen = df.select(F.col(text).alias("body")).where(F.pmod(F.xxhash64("body"), F.lit(1_000_000)) < share * 1_000_000).where(F.col("body").rlike(EVIDENCE.pattern))
    windows = emit(chosen, ["body"], "body", "form string, w binary", kernel).distinct()
    order = Window.partitionBy("form").orderBy(F.xxhash64("w"), "w")
    taken = windows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.when(F.col("form") == "", plain).otherwise(group))
    rows = [r.w for r in taken.select("form", "r", "w").orderBy("form", "r").collect()] + [w for line in made_lines() for _, w in labelled(line)]
    both = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 2, WINDOW).astype(np.int64)
    return both[:, 1], both[:, 0]


def trained(df: DataFrame, text: str) -> Tagger | None:
    """A tagger trained on the documents' windows; None if no document has a character of evidence."""
    if df.where(F.col(text).rlike(EVIDENCE.pattern)).isEmpty():
        return None
    model = Tagger(N_SHAPES, TAGS)
    model.train(*training_windows(df, text), steps=STEPS)
    return model


def reconcile(starts: list[int], tags: np.ndarray, sure: np.ndarray, length: int) -> list[tuple[int, int, int, float]]:
    """(kind, start, end, least certainty) of the spans that overlapping windows agree on character by character."""
    place = np.array(starts)[:, None] + np.arange(WINDOW)
    edge = np.broadcast_to(np.minimum(np.arange(WINDOW), WINDOW - 1 - np.arange(WINDOW)), place.shape)
    inside = (place >= 0) & (place < length)
    at, tag, certain, depth = place[inside], tags[inside], sure[inside], edge[inside]
    order = np.lexsort((-depth, at))
    at, tag, certain = at[order], tag[order], certain[order]
    first = np.concatenate([[True], at[1:] != at[:-1]])
    at, tag, certain = at[first], tag[first], certain[first]
    kind = (tag - 1) // 2
    begin = (tag > 0) & ((tag % 2 == 1) | np.concatenate([[True], (at[1:] != at[:-1] + 1) | (kind[1:] != kind[:-1]) | (tag[:-1] == 0)]))
    out = []
    for i in np.flatnonzero(begin).tolist():
        j = i + 1
        while j < len(at) and tag[j] > 0 and not begin[j]:
            j += 1
        out.append((int(kind[i]), int(at[i]), int(at[j - 1]) + 1, float(certain[i:j].min())))
    return out


def acceptable(kind: str, found: str) -> bool:
    """The test of an added span: that of its kind (digits, range, checksum), on what an address, a number or four
    numbers are in any spelling; whether it is personal data is for the tagger to say."""
    if found != found.strip() or "\n" in found:
        return False
    if kind == "email":
        return bool(ADDRESS.fullmatch(found))
    if kind == "ip":
        parts = re.split(rf"{SPELLED_DOT}|\.", found)
        return len(parts) == 4 and all(re.fullmatch("[0-9]+", p) for p in parts) and passes(kind, ".".join(parts))
    groups = re.split(r"[^0-9A-Za-z]{1,3}", found.strip("()[]{}<>"))
    if not all(re.fullmatch("[0-9]+", g) for g in groups):
        return False
    if kind == "phone":
        return 2 <= len(groups) <= 5 and all(2 <= len(g) <= 8 for g in groups) and 10 <= sum(map(len, groups)) <= 15
    return passes(kind, found)


def stretches(starts: list[int]) -> Iterator[tuple[list[int], float, float]]:
    """Windows to decode together, and the places from and to which the spans that begin there are theirs.

    Neighbouring stretches share OVERLAP windows, so all that cover a place, and a span from it, are together.
    """
    for i in range(0, len(starts), STRETCH):
        own = starts[i] if i else -math.inf, starts[i + STRETCH] if i + STRETCH < len(starts) else math.inf
        yield starts[max(0, i - OVERLAP) : i + STRETCH + OVERLAP], *own


def windows_of(text: str, starts: list[int]) -> np.ndarray:
    """The windows at these sorted starts, from the stretch of text around them alone."""
    a, b = max(0, starts[0]), min(len(text), starts[-1] + WINDOW)
    low = max(0, a - SPELLED)
    return cut(shapes_of(text[low : b + SPELLED])[a - low : b - low], [s - a for s in starts])


def tagged(jobs: list[tuple[str, list[int]]], model: Tagger) -> Iterator[tuple[int, int, int, int, float]]:
    """(job, kind, start, end, certainty) of all spans that the tagger finds in the jobs' texts, in order.

    However long a text is, the windows of one stretch, or of some short texts, are held at a time.
    """
    held: list[tuple[int, list[int], float, float]] = []

    def flush() -> Iterator[tuple[int, int, int, int, float]]:
        windows = np.concatenate([windows_of(jobs[j][0], s) for j, s, _, _ in held])
        done = [model.decode(windows[k : k + DECODE]) for k in range(0, len(windows), DECODE)]
        tags, sure = (np.concatenate([d[i] for d in done]) for i in (0, 1))
        at = 0
        for j, s, low, high in held:
            rows = slice(at, at + len(s))
            at += len(s)
            for k, a, b, certain in reconcile(s, tags[rows], sure[rows], len(jobs[j][0])):
                if low <= a < high:
                    yield j, k, a, b, certain

    size = 0
    for j, (_, starts) in enumerate(jobs):
        for stretch in stretches(starts):
            held.append((j, *stretch))
            size += len(stretch[0])
            if size >= STRETCH:
                yield from flush()
                held.clear()
                size = 0
    if held:
        yield from flush()


def find_spans(texts: list[str], model: Tagger | None) -> list[tuple[list, list]]:
    """Base spans and all spans of each text."""
    base = [base_spans(t) if EVIDENCE.search(t) else [] for t in texts]
    every = [list(b) for b in base]
    if model is None:
        return list(zip(base, every, strict=True))
    # long local parts first: where the tagger sees their begin
    looks = [(i, view(t, p), p) for i, t in enumerate(texts) if (p := without_middles(t)) is not None] + [(i, t, None) for i, t in enumerate(texts)]
    jobs = [(i, t, p, s) for i, t, p in looks if (s := window_starts(t))]
    taken = {}
    for i in {job[0] for job in jobs}:
        taken[i] = np.zeros(len(texts[i]), bool)
        for _, a, b in every[i]:
            taken[i][a:b] = True
    for j, k, a, b, certain in tagged([(t, s) for _, t, _, s in jobs], model):
        i, _, places, _ = jobs[j]
        if certain < SURE or (places is not None and KINDS[k] != "email"):
            continue
        if places is not None:
            a, b = int(places[a]), int(places[b - 1]) + 1
        if KINDS[k] == "email":
            a, b = whole_address(texts[i], a, b)
        if not taken[i][a:b].any() and acceptable(KINDS[k], texts[i][a:b]):
            every[i].append((k, a, b))
            taken[i][a:b] = True
    for spans in every:
        spans.sort()
    return list(zip(base, every, strict=True))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the first, longest one gives the kind."""
    parts, done = [], 0
    for a, b, k in sorted((a, -b, k) for k, a, b in spans):
        if a >= done:
            parts += [text[done:a], f"[{KINDS[k].upper()}]"]
        done = max(done, -b)
    return "".join([*parts, text[done:]]) if spans else text


def scanner(model: Tagger | None, text: str) -> Callable:
    def kernel():
        def work(part: pa.RecordBatch) -> list[pa.Array]:
            texts = [t or "" for t in part.column(part.schema.get_field_index(text)).to_pylist()]
            found = find_spans(texts, model)
            counts = [pa.array([sum(s[0] == k for s in b) for b, _ in found], pa.int64()) for k in range(len(KINDS))]
            digests = pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b, _ in found], pa.string())
            return [*counts, digests, pa.array([written(e) for _, e in found], pa.string()), pa.array([redacted(t, e) for t, (_, e) in zip(texts, found, strict=True)], pa.string())]

        return work

    return kernel


def find(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_email, n_ip, n_card, n_phone, base_sha256, spans and redacted.

    The counts and base_sha256 are of the base spans, spans has all: kind:start:end in code points, end exclusive, by
    kind, then start, comma-joined.  redacted is the text with every span replaced by its kind in brackets; where base
    spans overlap (their kinds are found apart), the one that begins first, then the longer one, gives the kind.  Null
    and empty texts have no spans.  Very long texts are scanned whole, some windows at a
    time.  Repeated rows get the same
    result each; a tagger sees their windows once.  An empty table, or one without a digit or at sign, needs no tagger.
    Columns with a result's name, in any case, are replaced, others stay.
    """
    fields: list[T.StructField] = [*(long(f"n_{k}") for k in KINDS), string("base_sha256"), string("spans"), string("redacted")]
    return with_columns(df, text, fields, scanner(trained(df, text), text))
