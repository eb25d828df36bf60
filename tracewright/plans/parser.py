"""A question in plain words to a :class:`QueryFilter`. Runs on the driver: it reads one short text.

The text is cut into words once. Each component of the grammar is a small reader that looks
at the words from one place on and says how many it takes; the first reader that takes any
wins, and its words are gone for the components after it. What nobody takes, without the
filler words, is what the question is about.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from tracewright.operators.filters import EntityFilters, QueryFilter, TimeRange

UTC = timezone.utc
_ISO = "%Y-%m-%dT%H:%M:%SZ"
HALF_HOUR = timedelta(minutes=30)

# Phrases that name an event id, with the channel it belongs to; the first that occurs counts.
EVENT_PHRASES = [
    (["failed logon", "logon failure", "failed login", "login failure"], "4625", "Security"),
    (["successful logon", "logon success", "logon successful", "successful login", "login success"], "4624", "Security"),
    (["logoff", "logged off", "user logoff"], "4634", "Security"),
    (["explicit credentials", "logon with explicit"], "4648", "Security"),
    (["special privileges assigned", "privileged logon"], "4672", "Security"),
    (["new process", "process creation", "process started"], "4688", "Security"),
    (["process terminated", "process exited"], "4689", "Security"),
    (["user account created", "created user account"], "4720", "Security"),
    (["account lock", "account lockout", "account locked", "user locked out"], "4740", "Security"),
    (["password reset", "reset password"], "4724", "Security"),
    (["audit log cleared", "event log cleared", "audit cleared"], "1102", "Security"),
    (["new service installed", "service installation"], "7045", "System"),
    (["service state changed", "service running state", "service stopped", "service started"], "7036", "System"),
    (["unexpected shutdown", "dirty shutdown"], "6008", "System"),
    (["application crash", "app crash", "application error", "app hang", "application hang"], "1000", "Application"),
]
# Phrases that name a channel.
CHANNEL_PHRASES = [
    ("Security", ["security", "logon", "login", "kerberos", "ntlm", "privilege"]),
    ("System", ["system log", "system event", "system channel", "system error", "service control manager", "scm", "driver fault", "bsod", "blue screen"]),
    ("Application", ["application log", "application event", "application channel", "application crash", "application error", "app crash", "wer", "drwatson"]),
]
# Event ids of audits, where a failure is no error level.
AUDITS = ["4624", "4625", "4634", "4648", "4672", "4688", "4689", "4720", "4740", "4724", "1102"]
# Phrasings that ask for links, and for numbers.
LINK_PHRASES = ["what else happened", "around the time of", "what happened before", "what happened after", "what happened right after", "did this cause", "correlated with", "related event", "related events", "timeline around"]
COUNT_PHRASES = ["how often", "how many", "frequency of", "count of", "trend", "how common", "all occurrences"]
# Words that say nothing about the content asked for.
FILLERS = [
    "show me", "find", "get", "display", "list", "tell me", "check", "please", "the", "a", "an", "for", "of", "on", "in", "around", "about", "at", "did", "ever",
    "how", "often", "many", "times", "event", "events", "log", "logs", "record", "records", "what", "occurred", "happened", "occurrence", "occurrences",
    "where", "which", "who", "with", "level", "severity", "source", "channel",
]
CLARIFY = "This could mean many events. Please narrow down the question: name a time (such as 'around 3pm yesterday'), or a user, host or process id."


def instant(text: str | None) -> datetime | None:
    """A time in ISO form (with blank or T, with or without zone: then UTC), else None."""
    try:
        t = datetime.fromisoformat(str(text).strip().replace("Z", "+00:00"))
    except ValueError:
        return None
    return t.astimezone(UTC) if t.tzinfo else t.replace(tzinfo=UTC)


@dataclass
class Word:
    text: str
    begin: int
    end: int

    @property
    def low(self) -> str:
        return self.text.lower()


#: Words that stand before a value, by field; a label may have parts that follow it.
LABELS = {
    "process_id": ["process", "proc", "pid"],
    "process_name": ["process", "image", "executable", "app", "application"],
    "thread_id": ["thread", "tid"],
    "status_code": ["status", "substatus", "error"],
    "logon_id": ["logon"],
    "user_id": ["user", "username", "account"],
    "computer": ["computer", "machine", "host", "workstation"],
    "provider": ["provider", "source"],
    "event_record_id": ["record"],
}
_PARTS = {"id", "#", "name", "code"}
_GLUE = {"is", "was", "called", "named", "=", ":"}
_LOOSE = _GLUE | {"for", "where", "with", "from", "on", "in"}
_SPLIT = {w for ws in LABELS.values() for w in ws} | {"event", "eventid", "id", "name", "code"}
#: Words that are never the name of a user, host or provider: those of the grammar itself, and small words.
_NO_NAME = _SPLIT | _LOOSE | {"a", "an", "the", "at", "who", "which", "this", "that", "ids", "users", "events", "error", "status", "log", "logs", "login", "failure", "success", "local", "remote", "server"}


def words_of(text: str) -> list[Word]:
    """The words with their places: white space parts them, outer punctuation goes, ``label=value`` comes apart."""
    out = []
    a = 0
    while a < len(text):
        if text[a].isspace():
            a += 1
            continue
        b = a
        while b < len(text) and not text[b].isspace():
            b += 1
        low, high = a, b
        while high - low > 1 and text[low] in ".,;?!()[]\"'#":
            low += 1
        while high - low > 1 and text[high - 1] in ".,;:?!()[]\"'":
            high -= 1
        cut = next((i for i in range(low, high) if text[i] in "=:#"), None)
        if cut is not None and text[low:cut].lower() in _SPLIT and cut + 1 < high:
            out += [Word(text[low:cut], low, cut), Word(text[cut + 1 : high], cut + 1, high)]
        else:
            out.append(Word(text[low:high], low, high))
        a = b
    return out


def _at(words: list[Word], i: int) -> str:
    return words[i].low if 0 <= i < len(words) else ""


# Times: (words taken, start, end, relative), or None.

_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_UNITS = {"minute": timedelta(minutes=1), "hour": timedelta(hours=1), "day": timedelta(days=1), "week": timedelta(days=7)}
_NEAR = {"around", "about", "approx", "approximately", "at"}


def _clock(words: list[Word], i: int) -> tuple[int, int, int] | None:
    """(words taken, hour, minute) of ``3pm``, ``3 pm``, ``15:30`` or ``3``."""
    w, half, taken = _at(words, i), "", 1
    if w.endswith(("am", "pm")):
        w, half = w[:-2], w[-2:]
    elif _at(words, i + 1) in ("am", "pm"):
        half, taken = _at(words, i + 1), 2
    hour, _, minute = w.partition(":")
    if not (hour.isdigit() and len(hour) <= 2 and (not minute and ":" not in w or minute.isdigit() and len(minute) == 2)):
        return None
    h, m = int(hour), int(minute or 0)
    if half and 1 <= h <= 12:
        h = h % 12 + 12 * (half == "pm")
    return (taken, h, m) if h < 24 and m < 60 else None


def _around(words: list[Word], i: int, ref: datetime, with_day: bool):
    got = _clock(words, i + 1) if _at(words, i) in _NEAR else None
    if got is None:
        return None
    taken, h, m = got
    day = _at(words, i + 1 + taken)
    if with_day and day not in ("yesterday", "today"):
        return None
    center = (ref - timedelta(days=with_day and day == "yesterday")).replace(hour=h, minute=m, second=0, microsecond=0)
    return 1 + taken + with_day, center - HALF_HOUR, center + HALF_HOUR, True


def _whole_day(day: datetime) -> tuple[datetime, datetime]:
    start = day.replace(hour=0, minute=0, second=0, microsecond=0)
    return start, start + timedelta(hours=23, minutes=59, seconds=59)


def _named_day(words: list[Word], i: int, ref: datetime):
    if _at(words, i) not in ("yesterday", "today"):
        return None
    return 1, *_whole_day(ref - timedelta(days=_at(words, i) == "yesterday")), True


def _back(words: list[Word], i: int, ref: datetime):
    if _at(words, i) not in ("last", "past"):
        return None
    number = _at(words, i + 1)
    n = int(number) if number.isdigit() else None
    unit = _at(words, i + 1 + (n is not None))
    if unit in ("week", "month") or n is not None and unit.removesuffix("s") in _UNITS:
        span = timedelta(days=30) if unit == "month" else _UNITS[unit.removesuffix("s")] * (n or 1)
        return 2 + (n is not None), ref - span, ref, True
    return None


def _calendar(words: list[Word], i: int, ref: datetime):
    if _at(words, i) != "on":
        return None
    first = _at(words, i + 1)
    if first[:4].isdigit() and len(first) == 10:
        day = instant(first)
        return (2, *_whole_day(day), False) if day else None
    number = _at(words, i + 2)
    if number[-2:] in ("st", "nd", "rd", "th"):
        number = number[:-2]
    if first[:3] not in _MONTHS or not number.isdigit():
        return None
    year = _at(words, i + 3)
    named = year.isdigit() and len(year) == 4
    try:
        day = datetime(int(year) if named else ref.year, _MONTHS.index(first[:3]) + 1, int(number), tzinfo=UTC)
    except ValueError:
        return None
    return 3 + named, *_whole_day(day), False


def _stamp(words: list[Word], i: int) -> tuple[int, datetime] | None:
    """(words taken, instant) of a date and time in one word or two."""
    for taken in (1, 2):
        text = " ".join(w.text for w in words[i : i + taken])
        if len(text) >= 16 and (t := instant(text)):
            return taken, t
    return None


def _between(words: list[Word], i: int, ref: datetime):
    a = _stamp(words, i + 1) if _at(words, i) == "between" else None
    if a is None or _at(words, i + 1 + a[0]) != "and":
        return None
    b = _stamp(words, i + 2 + a[0])
    return (2 + a[0] + b[0], a[1], b[1], False) if b else None


#: In the order in which they are tried.
TIME_READERS: list[Callable] = [
    lambda words, i, ref: _around(words, i, ref, True),
    lambda words, i, ref: _around(words, i, ref, False),
    _named_day,
    _back,
    _calendar,
    _between,
]


def time_range(words: list[Word], text: str, ref: datetime, bounds: tuple[str, str] | None) -> tuple[TimeRange | None, list[Word]]:
    """Range of the first reader that finds one, and the words without it."""
    for read in TIME_READERS:
        for i in range(len(words)):
            got = read(words, i, ref)
            if got is None:
                continue
            taken, start, end, relative = got
            low, high = (instant(b) for b in bounds) if bounds else (None, None)
            outside = bool(low and high and (end < low or start > high))
            raw = text[words[i].begin : words[i + taken - 1].end]
            return TimeRange(start.strftime(_ISO), end.strftime(_ISO), relative, raw, outside), words[:i] + words[i + taken :]
    return None, words


# Entities: (words taken, value), or None.


def _number(w: str) -> bool:
    return w.isdigit() or _hex(w)


def _hex(w: str) -> bool:
    return len(w) > 2 and w.lower().startswith("0x") and all(c in "0123456789abcdef" for c in w[2:].lower())


def _address(w: str) -> bool:
    parts = w.split(".")
    return len(parts) == 4 and all(p.isdigit() and len(p) <= 3 for p in parts)


def _sid(w: str) -> bool:
    head, *rest = w.split("-")
    return head == "S" and len(rest) >= 4 and rest[0] == "1" and all(p.isdigit() for p in rest)


def _program(w: str) -> bool:
    return w.lower().endswith((".exe", ".dll", ".sys", ".bin", ".scr"))


def _name(w: str) -> bool:
    return w.lower() not in _NO_NAME and all(c.isalnum() or c in "_.-\\" for c in w)


def _record(w: str) -> bool:
    return w.removeprefix("REC_").removeprefix("rec_").isdigit()


def _after(labels: list[str], value: Callable[[str], bool], glue: set[str] = frozenset({"=", ":"}), part: set[str] = _PARTS) -> Callable:
    """Reader of a label, its parts, words that only connect, and a value."""

    def read(words: list[Word], i: int):
        if _at(words, i) not in labels:
            return None
        j = i + 1
        while _at(words, j) in part:
            j += 1
        while _at(words, j) in glue:
            j += 1
        if j < len(words) and value(words[j].text):
            return j + 1 - i, words[j].text
        return None

    return read


def _alone(value: Callable[[str], bool]) -> Callable:
    return lambda words, i: (1, words[i].text) if value(words[i].text) else None


def _provider(words: list[Word], i: int):
    """All words behind the label up to one that goes on with the question."""
    if _at(words, i) not in LABELS["provider"]:
        return None
    a = i + 1
    while _at(words, a) in _GLUE:
        a += 1
    b = a
    while b < len(words) and _at(words, b) not in ("log", "event", "events", "in", "on", "with", "for"):
        b += 1
    value = " ".join(w.text for w in words[a:b])
    return (b - i, value) if len(value) >= 3 and _name(words[a].text) else None


def _status(words: list[Word], i: int):
    if _at(words, i) == "error" and _at(words, i + 1) != "code":
        return None
    return _after(LABELS["status_code"], _hex)(words, i)


#: Field -> readers, in the order in which they look.
ENTITY_READERS: list[tuple[str, list[Callable]]] = [
    ("process_id", [_after(LABELS["process_id"], _number)]),
    ("process_name", [_after(LABELS["process_name"], _program, _GLUE), _alone(lambda w: w.lower().endswith(".exe"))]),
    ("thread_id", [_after(LABELS["thread_id"], str.isdigit)]),
    ("ip_address", [_alone(_address)]),
    ("status_code", [_status]),
    ("logon_id", [_after(LABELS["logon_id"], _number)]),
    ("user_id", [_alone(_sid), _after(LABELS["user_id"], _name, _LOOSE, {"name"})]),
    ("computer", [_after(LABELS["computer"], _name, _LOOSE, {"name"})]),
    ("provider", [_provider]),
    ("event_record_id", [_after(LABELS["event_record_id"], _record)]),
]


def entities(words: list[Word]) -> tuple[EntityFilters, list[Word]]:
    found = EntityFilters()
    for field, readers in ENTITY_READERS:
        got = next(((i, *r) for read in readers for i in range(len(words)) if (r := read(words, i))), None)
        if got:
            i, taken, value = got
            if field == "event_record_id" and i and _at(words, i - 1) == "event":
                i, taken = i - 1, taken + 1
            setattr(found, field, value)
            words = words[:i] + words[i + taken :]
    return found, words


def _plain(text: str) -> list[str]:
    """Lower-case words without any punctuation, for phrases."""
    return "".join(c if c.isalnum() or c == "_" else " " for c in text.lower()).split()


def says(plain: list[str], *phrases: str) -> bool:
    """Whether one of the phrases stands in the words."""
    return any(plain[i : i + len(p)] == p for p in map(str.split, phrases) for i in range(len(plain) - len(p) + 1))


def event_id(words: list[Word]) -> tuple[str | None, str | None, list[Word]]:
    """(event id, channel it suggests, words without an explicit id)."""
    read = _after(["event", "eventid"], str.isdigit, {"=", ":"}, {"id", "#"})
    for i in range(len(words)):
        if got := read(words, i):
            return got[1], None, words[:i] + words[i + got[0] :]
    plain = _plain(" ".join(w.text for w in words))
    return next(((eid, channel, words) for phrases, eid, channel in EVENT_PHRASES if says(plain, *phrases)), (None, None, words))


def channel(text: str) -> str | None:
    plain = _plain(text)
    return next((c for c, phrases in CHANNEL_PHRASES if says(plain, *phrases)), None)


def level(text: str, source: str | None, eid: str | None) -> str | None:
    plain = _plain(text)
    failed = says(plain, "failed", "failure")
    audit = (source or "").lower() == "security" or eid in AUDITS
    for name, hit in (
        ("Critical", says(plain, "critical", "fatal")),
        ("Error", says(plain, "error", "errors", "fault", "crash") or failed and not audit),
        ("Warning", not failed and says(plain, "warning", "warn")),
        ("Information", not failed and says(plain, "info", "information", "informational")),
    ):
        if hit:
            return name
    return None


def intent(text: str, when: TimeRange | None, found: EntityFilters, eid: str | None) -> tuple[str, str | None]:
    """correlation, pattern_or_aggregate, specific_instance or ambiguous (with a question back)."""
    plain = _plain(text)
    # "did ... ever" asks for numbers as well, whatever stands between.
    counts = says(plain, *COUNT_PHRASES) or "did" in plain and "ever" in plain[plain.index("did") + 2 :]
    if says(plain, *LINK_PHRASES):
        return "correlation", None
    if counts and not found.any():
        return "pattern_or_aggregate", None
    if found.any() or (when is not None and (eid is not None or says(plain, "show me the", "find this"))):
        return "specific_instance", None
    return ("pattern_or_aggregate", None) if counts else ("ambiguous", CLARIFY)


def residue(words: list[Word]) -> str:
    """What is left without fillers and punctuation."""

    def kept() -> Iterator[str]:
        i = 0
        while i < len(words):
            n = next((len(f.split()) for f in FILLERS if [w.low for w in words[i : i + len(f.split())]] == f.split()), 0)
            if not n:
                yield "".join(c if c.isalnum() or c in "_.-" else " " for c in words[i].text)
            i += n or 1

    return " ".join(" ".join(kept()).split())


@dataclass
class QueryParser:
    """Parses one question at a time; ``reference`` stands for now unless a call gives its own."""

    reference: datetime | None = None

    def parse(self, question: str, reference: datetime | None = None, bounds: tuple[str, str] | None = None) -> QueryFilter:
        """Relative times count from ``reference``, else from the end of the data, else from now."""
        raw = (question or "").strip()
        ref = reference or self.reference or (instant(bounds[1]) if bounds else None) or datetime.now(UTC)
        ref = ref if ref.tzinfo else ref.replace(tzinfo=UTC)
        when, words = time_range(words_of(raw), raw, ref, bounds)
        found, words = entities(words)
        eid, hint, words = event_id(words)
        source = channel(raw) or hint
        kind, ask = intent(raw, when, found, eid)
        return QueryFilter(when, source, found, eid, level(raw, source, eid), residue(words) or raw, kind, raw, ask)


def parse(question: str, reference: datetime | None = None, bounds: tuple[str, str] | None = None) -> QueryFilter:
    return QueryParser().parse(question, reference, bounds)
