"""Values that can be told by their own shape: numbers, addresses, accounts. One text at a time, plain Python.

The text is read once into its runs of digits and what stands between them. A kind of number is a list of group
lengths (:func:`Numbers.take` walks the runs and checks that they break only where the kind allows) with what must
stand around it; there is no pattern per kind. Labels are looked for backwards from a value, addresses are read word
by word, and spoken e-mail addresses are written out before they are looked for.

A detector gives (start, end, category, grade, note) with code point offsets. :data:`DETECTORS` names them in the order
in which they run; the stable sort of the merge relies on it.
"""

from __future__ import annotations

import datetime as dt
import re
import unicodedata
from collections.abc import Callable

CERTAIN, LIKELY = "확실", "추정"
Found = tuple[int, int, str, str, str]

# Blanks, dashes and dots that may separate the parts of a number.
BLANKS = "  　"
DASHES = "-–—.·"
# Notes of the detectors.
NOTE_OK, NOTE_BAD = "체크섬 통과", "체크섬 불일치"
NOTE_RRN_BAD = "체크섬 불일치(2020.10 이후 발급분 가능)"
NOTE_FOREIGN, NOTE_SPOKEN, NOTE_ABROAD, NOTE_INSIDE = "외국인등록번호 형태", "한글로 풀어 쓴 번호", "해외 번호", "내선"
NOTE_MAIL, NOTE_LUHN, NOTE_ACCOUNT, NOTE_BIRTH = "말로 풀어 쓴 전자우편", "Luhn 통과", "계좌 문맥어 동반", "생년월일 문맥어 동반"
NOTE_HOME, NOTE_ROOM, NOTE_SERVICE, NOTE_LABEL = "공동주택 이름", "건물·호실", "서비스 이름 동반", "계정 이름표"
NOTE_NUMBER, NOTE_FORMAT, NOTE_PERSON_NO = "번호 이름표 동반", "과제번호 체계", "사번·학번 이름표"
# Words that must stand in a segment or its header for a detector to look.
CONTEXT = {
    "account": "계좌 예금주 입금 송금 은행 출금 account",
    "passport": "여권 passport",
    "driver": "운전면허 면허번호",
    "vehicle": "차량 차번호 자동차 번호판",
    "address": "주소 소재지 주소지 우편 address",
    "residence": "거주 사는 살며 살고 살던 살아 살았 산다 자택 이사 입주 주소 댁 집",
    "birth": "생년월일 생일 출생 birth DOB D.O.B",
}
# Labels before a value.
INSIDE_LABELS = "내선 구내 교환 ext ext."
PROJECT_LABELS = "과제 협약 접수"
PERSON_NUMBERS = "사번 학번 교번 직번 사원번호 직원번호 수험번호 회원번호"
SERVICES = "카카오톡 카톡 텔레그램 라인 위챗 인스타그램 인스타 트위터 페이스북 깃허브 디스코드 슬랙 스카이프 kakaotalk telegram instagram github slack skype discord"
ACCOUNT_LABELS = "ID 아이디 계정"
# Public formats of project numbers; 9 stands for a digit, A for a capital letter.
PROJECT_FORMATS = "2099A9A9A99999999 2099A9A9A9999999 NRF-2099A9A9A99999999 NRF-2099A9A9A9999999 RS-2099-99999999 2099-0-99999"
# Digits as they are read aloud, spoken signs of e-mail addresses.
SPOKEN_DIGITS = "공영일이삼사오육칠팔구"
SPOKEN_AT = "(at) [at] (골뱅이) [골뱅이] 골뱅이 앳"
SPOKEN_DOT = "(dot) [dot] (점) 닷 쩜"
# Parts of addresses and homes.
ADMIN = "특별자치시 특별자치도 특별시 광역시 도 시 군 구"
LOTS = "읍 면 동 리"
BUILDING_PARTS = "동 호 층 관 빌딩 타워 아파트 마을 빌라 오피스텔 맨션 단지"
HOMES = "아파트 빌라 오피스텔 맨션"
ROOM_PLACES = "관 빌딩 센터 타워 홀 연구동 실험동 기숙사"
PLAIN_HOMES = "임대 공공 민간 신축 노후 고층 저층 분양 재건축 재개발 국민 영구 행복 소형 중형 대형 일반 해당 인근 주변 서민 고급 신규 기존 공동 단지형 도시형"


def _any(words: str) -> str:
    return "|".join(map(re.escape, sorted(words.split(), key=len, reverse=True)))


_HAS = {k: re.compile(_any(v), re.IGNORECASE) for k, v in CONTEXT.items()}
_RUN = re.compile(r"\d+")


# ---- check digits


def weighted(d: str, weights: str) -> int:
    return sum(int(x) * int(w) for x, w in zip(d, weights, strict=False))


def birth_part(d: str) -> bool:
    """yymmdd can be a date; 29 February always can."""
    m, day = int(d[2:4]), int(d[4:6])
    return 1 <= m <= 12 and 1 <= day <= (31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[m - 1]


def resident_shape(d: str) -> bool:
    return len(d) == 13 and d[6] != "0" and birth_part(d)


def resident_check(d: str) -> bool:
    return (11 - weighted(d, "234567892345") % 11) % 10 == int(d[12])


def business_check(d: str) -> bool:
    return (10 - (weighted(d, "137137135") + int(d[8]) * 5 // 10) % 10) % 10 == int(d[9])


def corporate_check(d: str) -> bool:
    return (10 - weighted(d, "121212121212") % 10) % 10 == int(d[12])


def luhn(d: str) -> bool:
    return 13 <= len(d) <= 19 and sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(d))) % 10 == 0


# ---- numbers


class Numbers:
    """The digit runs of a text and what separates them: 'dash', 'blank', '' (something else or the end)."""

    def __init__(self, text: str, context: str):
        self.text, self.context = text, context
        self.runs = [m.span() for m in _RUN.finditer(text)]
        self.gaps = [self._gap(text[a[1] : b[0]]) for a, b in zip(self.runs, self.runs[1:], strict=False)] + [""]

    @staticmethod
    def _gap(between: str) -> str:
        if len(between) > 12:
            return ""
        bare = between.strip(BLANKS)
        return "blank" if not bare else "dash" if len(bare) == 1 and bare in DASHES else ""

    def digits(self, i: int, j: int) -> str:
        d = "".join(self.text[a:b] for a, b in self.runs[i : j + 1])
        return d if d.isascii() else unicodedata.normalize("NFKC", d)

    def take(self, i: int, lengths: tuple[int, ...], apart: bool = False) -> int | None:
        """The last run of a number that begins with run ``i`` and breaks only between its ``lengths`` (``apart``: at every one)."""
        ends, total = set(), 0
        for n in lengths:
            total += n
            ends.add(total)
        seen, j = 0, i
        while True:
            seen += self.runs[j][1] - self.runs[j][0]
            if seen == total:
                return j if not apart or j - i + 1 == len(lengths) else None
            if seen not in ends or not self.gaps[j]:
                return None
            j += 1

    def before(self, i: int, n: int = 1) -> str:
        a = self.runs[i][0]
        return self.text[max(0, a - n) : a]

    def after(self, j: int, n: int = 1) -> str:
        b = self.runs[j][1]
        return self.text[b : b + n]

    def span(self, i: int, j: int) -> tuple[int, int]:
        return self.runs[i][0], self.runs[j][1]

    def has(self, kind: str) -> bool:
        return _HAS[kind].search(self.context) is not None


def _scan(n: Numbers, one: Callable[[int], tuple[int, Found] | None]) -> list[Found]:
    """What ``one`` finds at each run, from left to right without overlap. ``one`` gives the last run used and the value."""
    out, i = [], 0
    while i < len(n.runs):
        hit = one(i)
        if hit:
            out.append(hit[1])
            i = hit[0]
        i += 1
    return out


def free(found: list[Found], taken: list[Found]) -> list[Found]:
    return [f for f in found if not any(f[0] < t[1] and t[0] < f[1] for t in taken)]


def resident(n: Numbers, as_of: dt.date) -> list[Found]:
    def one(i):
        j = n.take(i, (6, 7))
        if j is None:
            return None
        between = n.text[n.runs[i][1] : n.runs[j][0]] if j > i else ""
        if j > i and not set(between.strip(BLANKS)) & set("-–—"):
            return None
        d = n.digits(i, j)
        if not resident_shape(d):
            return None
        foreign, ok = d[6] in "5678", resident_check(d)
        note = NOTE_FOREIGN if foreign else NOTE_OK if ok else NOTE_RRN_BAD
        return j, (*n.span(i, j), "foreign_id" if foreign else "rrn", CERTAIN if j > i or ok else LIKELY, note)

    dashed = _scan(n, lambda i: one(i) if len(n.runs) > i + 1 and n.runs[i][1] - n.runs[i][0] == 6 else None)
    closed = _scan(n, lambda i: one(i) if n.runs[i][1] - n.runs[i][0] == 13 else None)
    return dashed + closed


_MOBILE = re.compile(r"0?1[016789]")
_AREA = re.compile(r"0(?:2|[3-6][1-5]|70|50\d)")


def _code(n: Numbers, i: int, code: re.Pattern) -> tuple[int, int, int] | None:
    """A number with an area or network code from run ``i``: (first run, last run, length of the code)."""
    first = n.digits(i, i)
    if n.before(i) == "(" and n.after(i) == ")" and code.fullmatch(first):
        # in brackets: what follows needs a dash
        k = i + 1
        if k < len(n.runs) and not n.text[n.runs[i][1] + 1 : n.runs[k][0]].strip(BLANKS):
            for m in (4, 3):
                j = n.take(k, (m, 4), apart=True)
                if j is not None and n.gaps[k] == "dash":
                    return i, j, -1
        return None
    for size in (4, 3, 2):
        if code.fullmatch(n.digits(i, min(len(n.runs) - 1, i + 1))[:size]) and len(first) >= size:
            for m in (4, 3):
                j = n.take(i, (size, m, 4))
                if j is not None:
                    return i, j, size
    return None


def _dialled(n: Numbers, i: int, code: re.Pattern) -> tuple[int, int, int] | None:
    """(start, end, last run) of a number, with the country code 82 or without."""
    first = n.digits(i, i)
    start = n.runs[i][0]
    if first.startswith("82"):
        at = start - 1 if n.before(i) == "+" else start
        if len(first) == 2:
            gap = n.text[n.runs[i][1] : n.runs[i + 1][0]] if i + 1 < len(n.runs) else ""
            if n.gaps[i] or gap.strip(BLANKS + DASHES) == "(":
                hit = _code(n, i + 1, code)
                if hit:
                    return at, n.runs[hit[1]][1], hit[1]
        else:
            for size in (4, 3, 2):
                if code.fullmatch(first[2 : 2 + size]):
                    for m in (4, 3):
                        j = n.take(i, (2 + size, m, 4))
                        if j is not None:
                            return at, n.runs[j][1], j
    hit = _code(n, i, code)
    if hit is None:
        return None
    return start - (hit[2] == -1), n.runs[hit[1]][1], hit[1]


_SPOKEN = re.compile(rf"(?<![가-힣])공일[공일육칠팔구][{BLANKS}{re.escape(DASHES)}]*([{SPOKEN_DIGITS}]{{3,4}})[{BLANKS}{re.escape(DASHES)}]*[{SPOKEN_DIGITS}]{{4}}(?![{SPOKEN_DIGITS}])")
_INSIDE = re.compile(rf"(?:{_any(INSIDE_LABELS)})[{BLANKS}]*(?:번호)?[{BLANKS}]*[:：]?[{BLANKS}]*$", re.IGNORECASE)


def telephone(n: Numbers, as_of: dt.date) -> list[Found]:
    def dialled(code, category):
        def one(i):
            hit = _dialled(n, i, code)
            return hit and (hit[2], (hit[0], hit[1], category, CERTAIN, ""))

        return _scan(n, one)

    def abroad(i):
        a = n.runs[i][0]
        first = n.digits(i, i)
        if n.before(i) != "+" or n.text[max(0, a - 2) : a - 1].isdigit() or len(first) > 3 or first.startswith("82"):
            return None
        j = i
        while j + 1 < len(n.runs) and j - i < 6 and n.runs[j + 1][1] - n.runs[j + 1][0] <= 4 and n.text[n.runs[j][1] : n.runs[j + 1][0]].strip("()") in (" ", "-"):
            j += 1
        if j - i < 2 or not 8 <= len(n.digits(i, j)) <= 15:
            return None
        return j, (a - 1, n.runs[j][1] + (n.after(j) == ")" and n.before(j) == "("), "tel", CERTAIN, NOTE_ABROAD)

    def inside(i):
        a, b = n.runs[i]
        if not 3 <= b - a <= 5 or not _INSIDE.search(n.text, max(0, a - 20), a):
            return None
        return i, (a, b, "tel", CERTAIN, NOTE_INSIDE)

    out = dialled(_MOBILE, "phone") if n.runs else []
    if "공일" in n.text:
        out += [(*m.span(), "phone", CERTAIN, NOTE_SPOKEN) for m in _SPOKEN.finditer(n.text)]
    out += free(dialled(_AREA, "tel"), out)
    if "+" in n.text:
        out += free(_scan(n, abroad), out)
    return out + free(_scan(n, inside), out)


def card(n: Numbers, as_of: dt.date) -> list[Found]:
    def one(i):
        j = n.take(i, (4, 4, 4, 4))
        return None if j is None else (j, n.span(i, j))

    return [(a, b, "card", CERTAIN, NOTE_LUHN) for a, b in _scan(n, one) if luhn(re.sub(r"\D", "", n.text[a:b]))]


def account(n: Numbers, as_of: dt.date) -> list[Found]:
    if not n.has("account"):
        return []

    def one(i):
        for parts in (4, 3):  # as many groups as there are
            j = i + parts - 1
            if j < len(n.runs) and all(n.gaps[i:j]):
                sizes = [b - a for a, b in n.runs[i : j + 1]]
                if all(lo <= s <= hi for s, (lo, hi) in zip(sizes, ((2, 6), (2, 6), (2, 7), (1, 6)), strict=False)):
                    return j, n.span(i, j)
        return None

    out = []
    for a, b in _scan(n, one):
        d = re.sub(r"\D", "", n.text[a:b])
        if 9 <= len(d) <= 16 and not (len(d) == 16 and luhn(d)):
            out.append((a, b, "account", CERTAIN, NOTE_ACCOUNT))
    return out


def registration(n: Numbers, as_of: dt.date) -> list[Found]:
    def business(i):
        j = n.take(i, (3, 2, 5), apart=True)
        if j is None:
            return None
        ok = business_check(n.digits(i, j))
        return j, (*n.span(i, j), "bizno", CERTAIN if ok else LIKELY, NOTE_OK if ok else NOTE_BAD)

    def corporate(i):
        j = n.take(i, (6, 7), apart=True)
        if j is None:
            return None
        d = n.digits(i, j)
        return (j, (*n.span(i, j), "corpno", CERTAIN, NOTE_OK)) if corporate_check(d) and not resident_shape(d) else None

    return _scan(n, business) + _scan(n, corporate)


def passport(n: Numbers, as_of: dt.date) -> list[Found]:
    capital = lambda c: c.isascii() and (c.isupper() or c.isdigit())
    out = []
    for i, (a, b) in enumerate(n.runs):
        if b - a == 8 and n.before(i).upper() in tuple("MSROD") and not capital(n.text[max(0, a - 2) : a - 1]) and not capital(n.after(i)):
            out.append((a - 1, b, "passport", CERTAIN if n.has("passport") else LIKELY, ""))
    return out


def driver(n: Numbers, as_of: dt.date) -> list[Found]:
    if not n.has("driver"):
        return []

    def one(i):
        j = n.take(i, (2, 2, 6, 2))
        if j is not None:
            return j, (*n.span(i, j), "driver", CERTAIN, "")
        j = n.take(i, (2, 6, 2))
        lead = re.search(rf"[가-힣]{{2}}(?:[{BLANKS}]*[{re.escape(DASHES)}]?[{BLANKS}]*)$", n.text[: n.runs[i][0]])
        return None if j is None or not lead else (j, (lead.start(), n.runs[j][1], "driver", CERTAIN, ""))

    return _scan(n, one)


def vehicle(n: Numbers, as_of: dt.date) -> list[Found]:
    if not n.has("vehicle"):
        return []

    def one(i):
        if i + 1 == len(n.runs) or not 2 <= n.runs[i][1] - n.runs[i][0] <= 3 or n.runs[i + 1][1] - n.runs[i + 1][0] != 4:
            return None
        between = n.text[n.runs[i][1] : n.runs[i + 1][0]]
        return (i + 1, (*n.span(i, i + 1), "vehicle", CERTAIN, "")) if re.fullmatch(r"[가-힣]\s?", between) else None

    return _scan(n, one)


def birth(n: Numbers, as_of: dt.date) -> list[Found]:
    if not n.has("birth"):
        return []

    def one(i):
        if i + 2 >= len(n.runs) or n.runs[i][1] - n.runs[i][0] != 4:
            return None
        marks = [n.text[n.runs[k][1] : n.runs[k + 1][0]].strip(BLANKS) for k in (i, i + 1)]
        if marks[0] not in tuple(".-/년") or marks[1] not in tuple(".-/월") or any(n.runs[k][1] - n.runs[k][0] > 2 for k in (i + 1, i + 2)):
            return None
        y, m, d = (int(n.digits(k, k)) for k in (i, i + 1, i + 2))
        try:
            if not dt.date(1900, 1, 1) <= dt.date(y, m, d) <= as_of:
                return None
        except ValueError:
            return None
        end = n.runs[i + 2][1]
        tail = n.text[end : end + 8].lstrip(BLANKS)
        if tail.startswith("일"):
            end = n.text.index("일", end) + 1
        return i + 2, (n.runs[i][0], end, "birth", CERTAIN, NOTE_BIRTH)

    return _scan(n, one)


# ---- e-mail


_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_HOST = re.compile(r"[A-Za-z0-9.\-]+")
_TOP = re.compile(r"(.+)\.[A-Za-z]{2,}")


def _mail_at(text: str, at: int, least: int = 0) -> tuple[int, int] | None:
    """The address around the @ at ``at``, not reaching before ``least``."""
    a = at
    while a > least and text[a - 1] in _LOCAL:
        a -= 1
    m = _HOST.match(text, at + 1)
    top = _TOP.match(m[0]) if m and a < at else None
    return (a, at + 1 + top.end()) if top else None


def _mails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        hit = _mail_at(text, at, done)
        if hit:
            out.append(hit)
            done = hit[1]
        at = text.find("@", max(at + 1, done))
    return out


_SAID_AT = re.compile(rf"[{BLANKS}]*(?:{_any(SPOKEN_AT)})[{BLANKS}]*", re.IGNORECASE)
_SAID_DOT = re.compile(rf"[{BLANKS}]*(?:{_any(SPOKEN_DOT)})[{BLANKS}]*|[{BLANKS}]+(?:dot|점)[{BLANKS}]+", re.IGNORECASE)
_PLAIN_AT = re.compile(rf"[{BLANKS}]+at[{BLANKS}]+", re.IGNORECASE)


def _written_out(text: str, *signs: tuple[re.Pattern, str]) -> tuple[str, list[int], set[int]]:
    """The text with spoken signs put as characters: itself, the place of each character before, and where signs stand."""
    hits = sorted((m.start(), -m.end(), c) for p, c in signs for m in p.finditer(text))
    out, at, spoken, done = [], [], set(), 0
    for a, minus, c in hits:
        if a < done:
            continue
        out += text[done:a]
        at += range(done, a)
        spoken.add(len(out))
        out.append(c)
        at.append(a)
        done = -minus
    out += text[done:]
    at += range(done, len(text) + 1)
    return "".join(out), at, spoken


def _spoken_mails(text: str, at_sign: re.Pattern, need_dot: bool) -> list[tuple[int, int]]:
    plain, place, spoken = _written_out(text, (at_sign, "@"), (_SAID_DOT, "."))
    out = []
    for a, b in _mails(plain):
        at = plain.index("@", a)
        if at in spoken and plain[a].isalnum() and (not need_dot or any(k in spoken for k in range(at + 1, b))):
            out.append((place[a], place[b - 1] + 1))
    return out


def mail(n: Numbers, as_of: dt.date) -> list[Found]:
    t = n.text
    out = [(a, b, "email", CERTAIN, "") for a, b in _mails(t)] if "@" in t else []
    low = t.lower()
    if "at)" in low or "at]" in low or "골뱅이" in t or "앳" in t:
        out += free([(a, b, "email", CERTAIN, NOTE_MAIL) for a, b in _spoken_mails(t, _SAID_AT, False)], out)
    if " at " in low and _SAID_DOT.search(t):
        out += free([(a, b, "email", CERTAIN, NOTE_MAIL) for a, b in _spoken_mails(t, _PLAIN_AT, True)], out)
    return out


# ---- labelled codes


_TOKEN = re.compile(r"[A-Za-z0-9_.\-]+")
_IN_SERVICE = re.compile(rf"(?:{_any(SERVICES)})[{BLANKS}]*(?:{_any(ACCOUNT_LABELS)})?[{BLANKS}]*[:：]?[{BLANKS}]*@?$", re.IGNORECASE)
_IN_ACCOUNT = re.compile(rf"(?<![A-Za-z가-힣])(?:{_any(ACCOUNT_LABELS)})[{BLANKS}]*[:：][{BLANKS}]*@?$")
_IN_PROJECT = re.compile(rf"(?:{_any(PROJECT_LABELS)})[{BLANKS}]*(?:고유)?[{BLANKS}]*번호[{BLANKS}]*[:：]?[{BLANKS}]*$")
_IN_PERSON = re.compile(rf"(?:{_any(PERSON_NUMBERS)})[{BLANKS}]*[:：(（]?[{BLANKS}]*$")
_FORMATS = re.compile("|".join(f.replace("9", r"\d").replace("A", "[A-Z]").replace(r"20\d\d", r"20\d\d") for f in PROJECT_FORMATS.split()))


def handle(n: Numbers, as_of: dt.date) -> list[Found]:
    if not _IN_ANY.search(n.text):
        return []
    named, labelled = [], []
    for m in _TOKEN.finditer(n.text):
        a = m.start()
        value = m[0][:30].rstrip(".-")
        if not m[0][0].isalpha() or len(m[0]) < 4 or len(m[0]) > 30 or n.text[m.end() : m.end() + 1] == "@" or not any(c.isdigit() or c in "_." for c in value):
            continue
        if _IN_SERVICE.search(n.text, max(0, a - 30), a):
            named.append((a, a + len(value), "handle", CERTAIN, NOTE_SERVICE))
        elif _IN_ACCOUNT.search(n.text, max(0, a - 12), a):
            labelled.append((a, a + len(value), "handle", LIKELY, NOTE_LABEL))
    return named + free(labelled, named)


_IN_ANY = re.compile(f"{_any(SERVICES)}|{_any(ACCOUNT_LABELS)}", re.IGNORECASE)


def project(n: Numbers, as_of: dt.date) -> list[Found]:
    t, out = n.text, []
    if "번호" in t:
        for m in re.finditer(r"[A-Za-z0-9][A-Za-z0-9_\-]*", t):
            if 6 <= len(m[0]) <= 25 and any(map(str.isdigit, m[0])) and _IN_PROJECT.search(t, max(0, m.start() - 20), m.start()):
                out.append((*m.span(), "project_no", CERTAIN, NOTE_NUMBER))
    shaped = []
    if "20" in t:
        for m in re.finditer(r"[A-Za-z0-9][A-Za-z0-9\-]*", t):
            for f in (_FORMATS.fullmatch(m[0]),):
                if f:
                    shaped.append((*m.span(), "project_no", CERTAIN, NOTE_FORMAT))
    people = []
    if re.search("번", t):
        for m in re.finditer(r"[A-Za-z]{0,3}\d{5,12}", t):
            if t[m.end() : m.end() + 1].isascii() and t[m.end() : m.end() + 1].isalnum():
                continue
            if _IN_PERSON.search(t, max(0, m.start() - 12), m.start()):
                people.append((*m.span(), "handle", CERTAIN, NOTE_PERSON_NO))
    return out + free(shaped, out) + people


# ---- addresses


_PLACE_WORD = re.compile(r"[^\s,()]+")
_ADMIN_UNIT = re.compile(rf"[가-힣]{{2,10}}?(?:{_any(ADMIN)})")
_ROAD_HEAD = re.compile(r"[가-힣A-Za-z0-9]{1,12}(?:로|길)")
_HOUSE = re.compile(r"\d+(?:-\d+)?")
_LOT_HEAD = re.compile(rf"[가-힣]{{1,10}}(?:{_any(LOTS)})")
_BUILDING = re.compile(rf"[가-힣A-Za-z0-9]{{1,12}}(?:{_any(BUILDING_PARTS)})")
_HOME = re.compile(rf"(?<![가-힣A-Za-z0-9])([가-힣A-Za-z0-9]{{2,10}})(?:{_any(HOMES)})")
_ROOM = re.compile(rf"(?<![가-힣A-Za-z0-9])(?:\d{{1,4}}동|[가-힣A-Za-z0-9]{{1,10}}(?:{_any(ROOM_PLACES)}))[{BLANKS}]?[A-Za-z]?\d{{2,4}}호(?!\d)")


def _blank(text: str, at: int) -> int:
    while at < len(text) and text[at] in BLANKS:
        at += 1
    return at


def _units(text: str, at: int) -> list[int]:
    """Ends of one, two, three administrative units that begin at ``at``."""
    ends = []
    for _ in range(3):
        m = _ADMIN_UNIT.match(text, at)
        if not m:
            break
        # the longest unit of the word: 서울특별시 rather than 서울특별
        while (longer := _ADMIN_UNIT.fullmatch(text, m.start(), m.end() + 1)) or (longer := _ADMIN_UNIT.fullmatch(text, m.start(), m.end() + 2)):
            m = longer
        ends.append(m.end())
        at = _blank(text, m.end())
    return ends


def _road(text: str, at: int) -> int | None:
    """End of a road with a house number."""
    m = _ROAD_HEAD.match(text, at)
    if not m:
        return None
    end = m.end()
    at = end + (text[end : end + 1].isspace())
    h = _HOUSE.match(text, at)
    while not h and (shorter := _ROAD_HEAD.match(text[: end - 1], m.start())):
        end = shorter.end()
        h = _HOUSE.match(text, end)
    if not h:
        return None
    end = h.end()
    if text.startswith("번길", end):
        more = _HOUSE.match(text, end + 2 + text[end + 2 : end + 3].isspace())
        end = more.end() if more and "-" not in more[0] else end if more is None else end + 2 + text[end + 2 : end + 3].isspace() + len(more[0].split("-")[0])
    return end


def _buildings(text: str, end: int) -> int:
    """The end after buildings, floors and rooms that follow a house number."""
    while True:
        at = _blank(text, end)
        if text[at : at + 1] in (",", "("):
            at = _blank(text, at + 1)
        m = _BUILDING.match(text, at)
        if not m:
            return end
        end = m.end() + (text[m.end() : m.end() + 1] in (",", ")") and bool(text[m.end() : m.end() + 1]))


def address(n: Numbers, as_of: dt.date) -> list[Found]:
    t = n.text
    whole, lots, roads, homes, rooms = [], [], [], [], []
    if n.runs:
        at = 0
        for m in _PLACE_WORD.finditer(t):
            a = m.start()
            if a < at:
                continue
            ends = _units(t, a)
            for e in reversed(ends):
                r = _road(t, _blank(t, e))
                if r:
                    at = _buildings(t, r)
                    whole.append((a, at, "address", CERTAIN, ""))
                    break
            else:
                for e in reversed(ends):
                    lot = _LOT_HEAD.match(t, _blank(t, e)) if _blank(t, e) > e else None
                    h = _HOUSE.match(t, _blank(t, lot.end())) if lot and _blank(t, lot.end()) > lot.end() else None
                    if h:
                        at = h.end() + 2 * t.startswith("번지", h.end())
                        lots.append((a, at, "address", CERTAIN, ""))
                        break
        if n.has("address"):
            at = 0
            for m in _PLACE_WORD.finditer(t):
                r = _road(t, m.start()) if m.start() >= at else None
                if r:
                    at = _buildings(t, r)
                    roads.append((m.start(), at, "address", CERTAIN, ""))
    if any(h in t for h in HOMES.split()):
        for m in _HOME.finditer(t):
            unit = re.match(rf"(?:[{BLANKS}]*\d{{1,4}}동)?(?:[{BLANKS}]*\d{{1,4}}호)?", t[m.end() :])[0]
            if m[1] not in PLAIN_HOMES.split() and not t[m.end() + len(unit) : m.end() + len(unit) + 1].isdigit() and (unit or n.has("residence")):
                homes.append((m.start(), m.end() + len(unit), "address", LIKELY, NOTE_HOME))
    if "호" in t:
        rooms = [(*m.span(), "address", LIKELY, NOTE_ROOM) for m in _ROOM.finditer(t)]
    out = whole + free(lots, whole)
    out += free(roads, out)
    out += free(homes, out)
    return out + free(rooms, out)


DETECTORS: dict[str, Callable[[Numbers, dt.date], list[Found]]] = {
    "rrn": resident, "phone": telephone, "email": mail, "card": card, "account": account, "bizno": registration, "passport": passport, "driver": driver, "vehicle": vehicle,
    "address": address, "birth": birth, "handle": handle, "project_no": project,
}


def find(text: str, header: str | None = "", only: tuple[str, ...] | None = None, as_of: dt.date = dt.date(2026, 1, 1)) -> list[Found]:
    """Every value of ``text``, in the order of the detectors. ``header`` is read for context words only."""
    if not text:
        return []
    n = Numbers(text, f"{header} {text}" if header else text)
    return [f for name, run in DETECTORS.items() if only is None or name in only for f in run(n, as_of)]
