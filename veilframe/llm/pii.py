"""Personal information in free text: find it, name its category, put a placeholder in its place.

Three steps for each text, all in one pass without a shuffle:

1. *propose*: regular expressions over the text's skeleton propose spans. The skeleton has look-alike, wide,
   decomposed and invisible characters replaced or dropped; each of its characters knows the stretch of the stored
   text it came from, so offsets are always those of the text as stored, in code points;
2. *confirm*: validators judge the proposals - the birth date and the mod-11 check digit of resident numbers, Luhn for
   cards, mod 97 for account numbers of the IBAN form, number lengths, domain shapes. Thirteen digits in a row with
   nothing else to speak for them are a resident number only if the check digit is right; digits that pass Luhn as a
   card or mod 97 as an account are no telephone number;
3. *weigh*: words nearby (labels, titles, particles, the cell's header, the category somebody recorded) raise or
   lower a proposal's score. Proposals at or above :data:`THRESHOLD` stay; of overlapping ones the better score,
   then the longer, then the earlier wins.

Defined results: a null or empty text has no spans and stays as it is. Equal texts get equal results. A text of any
length is scanned whole. Surrogates and control characters are ordinary characters. Other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.lexicon import SURNAMES as ALL_SURNAMES
from veilframe.llm.lookalike import decomposed
from veilframe.llm.nicknames import GIVEN_NAMES

CATEGORIES = ("person", "phone", "tel", "email", "address", "rrn", "foreign_id", "passport", "driver")
#: Also found, to keep them from being taken for something else, and given on request.
OTHER = ("card", "iban")
THRESHOLD = 0.5

# Frequent Korean family names, of one and of two syllables. The rarer ones of the core's list need a
# word nearby that speaks for a name.
SURNAMES = "강고곽구권김남노도류문민박방배백변서석성소손송신심안양엄염오우원유윤이임장전정조주지진차채천최추하한함허현홍황공"
RARE_SURNAMES = "".join(c for c in ALL_SURNAMES if c not in SURNAMES)
SURNAMES_2 = "남궁 독고 동방 사공 서문 선우 제갈 황보"
# Syllables of Korean given names.
GIVEN = "가건겸경광교국규균근기나난늘다단담도동라란람랑로루리린림마명모묵미민바범별보본비빈빛상새서선설섭세소솔수순슬승시식아안언여연열영예온완우욱운원유윤율은음의이인일자재정제종주준중지진찬창채초태필하한해훈현호희혜숙옥철석"
# How the family names are written in Latin letters.
SURNAMES_LATIN = """Gang Kang Go Ko Gwak Kwak Gu Koo Gwon Kwon Gim Kim Nam Namgung No Noh Roh Do Ryu Mun Moon Min Bak Park Bang Bae Baek Byeon Seo Seok Seong
Sung So Son Song Sin Shin Sim Shim An Ahn Yang Eom Yeom O Oh U Woo Won Yu Yoo Yun Yoon I Yi Lee Im Lim Jang Jeon Jeong Jung Jo Cho Ju Joo Ji Jin Cha Chae Cheon Choe Choi Chu
Ha Han Ham Heo Hyeon Hong Hwang Gong Seonu Jegal Hwangbo Dokgo Dongbang Sagong Seomun"""
# Titles and forms of address that follow a name.
TITLES = "책임연구원 선임연구원 수석연구원 연구책임자 연구위원 명예교수 부교수 조교수 본부장 센터장 위원장 사무관 주무관 연구관 연구사 서기관 연구원 이사장 교수 박사 부장 차장 과장 팀장 실장 단장 소장 원장 총장 학장 처장 국장 관장 대표 이사 사장 회장 위원 간사 대리 주임 선생 의원 기자 변호사 씨 님 군 양"
# Labels before a name.
LABELS = "성명 이름 담당자 담당 예금주 참석자 참석 불참자 불참 발신 수신 작성자 작성 책임자 연구책임자 대표자 발표자 발표 신청인 신청자 확인자 검토자 기안자 보낸사람 받는사람 연락망"
# Particles after a name.
PARTICLES = "이라는 이라고 라는 라고 께서 에게서 에게 한테 이며 이고 이다 입니다 까지 부터 으로 은 는 이 가 을 를 와 과 의 도 만 께 로"
# Everyday two-syllable words that start like a name; with an ending they are no name.
PLAIN_WORDS = "차이 오늘 정한 공정 전제 배제 하루 장소 장비 조정 구경 정리 추진 공연 안내 전화 주소 우리 하나 이번 이후 이상 이하 이미 이를 전체 전부 주제 주의 지난 지금 지역 지원 진행 진단 조사 조건 최근 최소 최대 최종 최초 한편 현재 현장 하지 정도 정보 제한 성과 소재 소개 손해 심사 심의 안전 안정 양식 여부 연구 오전 오후 우선 우수 운영 원인 유지 유의 의견 임시 장기 전문 조성 주요 지도 지시 진리 차례 도시 도로 도구 신청 방안 방법 문제 민원 백만 서류 서식 남은 강의 강조 고려 구성 권한 기준 공지 공고 공유 공동 공사 도입 도출 도담 구분 소속 성명 직위 연락 이메 미정 상동"
ADDRESS_TAIL = "본관|별관|신관|연구동|산학관|[가-힣]{1,6}(?:아파트|빌라|빌딩|타워|오피스텔|맨션|연립|주택)"
# Endings of English street names.
STREETS = "Drive Lane Road Street Avenue Way Court Close Square Terrace Boulevard Row Crescent Place Hill Gardens Grove Walk Mews Parkway Highway Alley Circle Trail Path Plaza Broadway Quay Rise Green Park View Yard St Ave Rd Dr Ln Blvd Holloway"
# Words that make two capitalised words something else than a name.
NOT_NAMES = "The Please Passport Number This That These Those There Where When After Before Because Although Existing However Today Tomorrow Nobody Anyone Whether Should Since First Next Then Our Their They Institute Research Energy University Center Centre Foundation Association Agency Company Data Robot In On At As If For So We He She You It Our Now And But Or"

_alt = lambda words: "|".join(sorted(words.split(), key=len, reverse=True))
_H = "가-힣"
_NAME = rf"(?:(?:{_alt(SURNAMES_2)})[{GIVEN}]{{2}}|[{ALL_SURNAMES}][{GIVEN}]{{2}})"
_SPLIT = rf"(?:(?:{_alt(SURNAMES_2)}) [{GIVEN}] ?[{GIVEN}]|(?:{'|'.join(' '.join(x) for x in SURNAMES_2.split())}) [{GIVEN}] ?[{GIVEN}]|[{SURNAMES}] [{GIVEN}] ?[{GIVEN}])"
_TAIL = rf"(?:(?:{_alt(TITLES)})님?)?(?:{_alt(PARTICLES)})?"
RE_NAME = re.compile(rf"(?<![{_H}A-Za-z0-9])(?:({_NAME})|({_SPLIT}))(?={_TAIL}(?![{_H}A-Za-z]))")
_CAP = r"[A-ZÀ-Þ][a-zß-ÿ'’]+"
RE_LATIN = re.compile(
    rf"(?<![A-Za-zÀ-ÿ0-9@._+-])(?:(?P<up>[A-Z]{{1,9}},? [A-Z][a-z]*-[a-z]+)|(?P<last>{_CAP}, {_CAP})(?![A-Za-z])|(?P<first>{_CAP}(?:-[a-z]+)?(?: [A-Z]\.)? (?:[A-ZÀ-Þ][a-zß-ÿ'’]*)))(?![A-Za-zÀ-ÿ0-9@_])"
)
_KO_LATIN = frozenset(SURNAMES_LATIN.split())
_COMPOUND = frozenset(SURNAMES_2.split())
_KO_LATIN_UP = frozenset(x.upper() for x in SURNAMES_LATIN.split())
_NOT_NAMES, _STREETS, _PLAIN = frozenset(NOT_NAMES.split()), frozenset(STREETS.split()), frozenset(PLAIN_WORDS.split())
_ENDINGS = frozenset("이가은는을를의로한해하다도나라인")
_RARE_ENDINGS = _ENDINGS | frozenset("서고면와과만며들")
_UNSURE = frozenset("이한전현제지주우정하도")
RE_TOPIC_BEFORE = re.compile(rf"[{_H}]{{2,}}[은는]\s+$")
RE_BEFORE = re.compile(rf"(?:(?:{_alt(LABELS)})[은는]?\]?\s*[:：]?\s*|→\s*|(?:재단|협회|대학교|연구원|센터|진흥원|기술원|\(주\)|[{_H}]{{2,}}(?:팀|실|부|과))\s+|(?:by|for|contact|from|to|Dr\.|Mr\.|Ms\.|Prof\.)\s+|^\s*|[,/(]\s*)$")
RE_STRONG_BEFORE = re.compile(rf"(?:(?:{_alt(LABELS)})[은는]?\]?\s*[:：]?\s*|[→\]]\s*|(?:by|for|contact|Dr\.|Mr\.|Ms\.|Prof\.)\s+)$")
RE_AFTER = re.compile(rf"(?:\s*(?:{_alt(TITLES)})(?:님|이|가|은|는|께|과|와|을|를|의|\s|$|[.,(/)])|\s*\(?[(+0]|\s*공일공|이?라는|[이가] (?:[{_H}]+(?:시|도|구|군)\s|\d+ [A-Z])|\s*[,/)→]|,|\s*$)")
RE_STRONG_AFTER = re.compile(rf"(?:\s*(?:{_alt(TITLES)})(?:님|이|가|은|는|께|과|와|을|를|의|\s|$|[.,(/)])|\s*\(?[(+]?0\d|\s*\+\d|\s*공일공| at(?: |$)|이?라는|[이가] (?:[{_H}]+(?:시|도|구|군)\s|\d+ [A-Z]))")

_D, _E = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
RE_RRN = re.compile(rf"(?<![0-9A-Za-z.-])(\d{{6}})(?:\s?-\s?|\s)?(\d{{7}})(?![0-9A-Za-z]|-\d)")
RE_MOBILE = re.compile(
    rf"(?<![0-9A-Za-z-])(?:\+82[\s.-]?\(?0?\)?1[016789]|\(0?1[016789]\)|01[016789])(?:[\s.-]\d{{3,4}}[\s.-]\d{{4}}|\)?\s?\d{{3,4}}[-.\s]\d{{4}}|\d{{7,8}})(?![0-9A-Za-z]|-\d)"
    r"|공일[공일육칠팔구](?:\s?[-.·]\s?|\s)?[공영일이삼사오육칠팔구]{3,4}(?:\s?[-.·]\s?|\s)?[공영일이삼사오육칠팔구]{4}(?![공영일이삼사오육칠팔구])"
)
_AREA = r"0(?:2|[3-6][1-5]|70|50\d|80)"
RE_TEL = re.compile(rf"(?<![0-9A-Za-z+.-])(?:\({_AREA}\)|{_AREA}\)|{_AREA}(?=[-.\s]))[-.\s]?\d{{3,4}}[-.\s]\d{{4}}(?![0-9A-Za-z]|-\d)|(?<![0-9A-Za-z+])\+(?!82[\s.-]?\(?0?\)?1[016789])\d{{1,3}}(?:[\s.-](?:\(\d{{1,4}}\)|\d{{1,4}})){{2,5}}(?![0-9A-Za-z]|-\d)|(?<![0-9A-Za-z+.-]){_AREA}\d{{7,8}}(?![0-9A-Za-z]|-\d)")
RE_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_+])?(?:@|\s?[(\[]at[)\]]\s?|\s?(?:골뱅이|앳)\s?| at (?=[A-Za-z0-9-]+ (?:dot|\[dot\])))[A-Za-z0-9-]+(?:(?:\.|\s?[(\[]dot[)\]]\s?|\s?(?:닷|쩜)\s?| dot )[A-Za-z0-9-]+)+", re.IGNORECASE)
RE_PASSPORT = re.compile(rf"{_D}[MSRODmsrod]\d{{8}}{_E}")
RE_DRIVER = re.compile(rf"(?<![0-9A-Za-z-])(?:\d{{2}}|(?<![{_H}])[{_H}]{{2}})(?:\s?-\s?|\s)\d{{2}}\s?-\s?\d{{6}}\s?-\s?\d{{2}}(?![0-9A-Za-z]|-\d)")
_ADMIN = rf"(?:[{_H}]{{1,5}}(?:특별자치시|특별자치도|특별시|광역시|시|도|구|군))"
_ROOM = rf"(?:,?\s?(?:(?:{ADDRESS_TAIL})(?:\s?\d+동)?(?:\s?\d+(?:-\d+)?호)?|[{_H}]{{1,8}}\s?\d+(?:-\d+)?호|\d+동\s?\d+호)(?![{_H}0-9](?<![은는이가을를로에과와의])))"
RE_ADDRESS = re.compile(
    rf"(?<![{_H}0-9A-Za-z])(?P<admin>(?:{_ADMIN}\s){{0,3}})(?:(?P<road>[{_H}]{{1,8}}(?:로|길)(?:\s?\d+번?길)?)\s?\d+(?:-\d+)?(?:번지)?|(?P<lot>[{_H}]{{1,8}}(?:동|읍|면|리|가)(?:\s[{_H}]{{1,6}}리)?)\s(?:산\s?)?\d+(?:-\d+)?(?:번지)?)(?![0-9-]\d|[천만백억원건명층회차년월일시분개%]){_ROOM}?"
)
RE_ADDRESS_EN = re.compile(rf"(?<![0-9A-Za-z-])\d{{1,5}} (?:[A-Z][a-z]+(?:-[A-Z][a-z]+)? ){{0,3}}(?:(?P<street>{_alt(STREETS)})|[A-Z][a-z]+), [A-Z][a-z]+(?: [A-Z][a-z]+)?(?![A-Za-z])")
#: Ten digits of the North American plan: the area begins with 2 to 9.
RE_TEL_US = re.compile(r"(?<![0-9A-Za-z+.-])(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[-. ])\d{3}[-.]\d{4}(?![0-9A-Za-z]|-\d)")
RE_CARD = re.compile(rf"(?<![0-9A-Za-z-])\d{{4}}([ -]?)\d{{4}}\1\d{{4}}\1\d{{4}}(?![0-9A-Za-z]|-\d)")
RE_IBAN = re.compile(rf"{_D}[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{_E}")

_RE_DIGITS, _RE_CAPITAL = re.compile(r"\d+"), re.compile("[A-ZÀ-Þ][^ ]* [A-ZÀ-Þ]")
_RE_ADDRESS_HINT, _RE_AT = re.compile(r"[로길동읍면리가] ?산?\s?\d"), re.compile(r"@|골뱅이|앳|[(\[ ]at[)\] ]", re.IGNORECASE)
_PARTICLES = frozenset(PARTICLES.split())
_PLAIN_CHARS = re.compile(r"[^\n\t -~가-힣À-ÿ·–☎→※○●]|·|­| ")
_CUE_WORDS = {
    "rrn": re.compile("주민|등록번호"), "foreign_id": re.compile("외국인|등록번호"), "passport": re.compile("여권|[Pp]assport"), "driver": re.compile("면허"),
    "phone": re.compile("휴대|연락|전화|핸드폰"), "tel": re.compile("전화|☎|연락|[Tt]el"), "email": re.compile("메일|회신|mail|contact"), "address": re.compile("주소|우편|거주|소재|[Aa]ddress|[Mm]ail|[Ll]ives|[Rr]esid"),
    "person": re.compile("성명|이름|담당|책임자|대표자|작성자|예금주"),
}
_MARKS = re.compile(r"[̀-ͯᅠ-ᇿ]")


def birth_ok(d: str) -> bool:
    """Month and day of yymmdd can be a date."""
    m, day = int(d[2:4]), int(d[4:6])
    return 1 <= m <= 12 and 1 <= day <= (31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[m - 1]


def mod11_ok(d: str) -> bool:
    """Check digit of a resident number (numbers since October 2020 need not have it)."""
    return (11 - sum(int(x) * w for x, w in zip(d, (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5), strict=False)) % 11) % 10 == int(d[12])


def luhn_ok(d: str) -> bool:
    total = sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(d)))
    return 13 <= len(d) <= 19 and total % 10 == 0


def mod97_ok(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def skeleton(text: str) -> tuple[str, list[int] | None, list[int] | None]:
    """The text as it looks, with the start and end in ``text`` of each of its characters (None: the same)."""
    if not _PLAIN_CHARS.search(text):
        return text, None, None
    out: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    i, n = 0, len(text)
    while i < n:
        j = i + 1
        while j < n and _MARKS.match(text[j]):
            j += 1
        shown = unicodedata.normalize("NFC", "".join(map(decomposed, text[i:j])) if j > i + 1 or not "가" <= text[i] <= "힣" else text[i])
        for c in shown:
            out.append(c)
            starts.append(i)
            ends.append(j)
        if not shown and j == i + 1 and out and i + 1 < n and _MARKS.match(text[i + 1]):
            pass
        i = j
    return "".join(out), starts, ends


def _near(category: str, s: str, a: int, header: str, recorded: str) -> float:
    cue = _CUE_WORDS.get(category)
    return (0.2 if cue and (cue.search(header) or cue.search(s, max(0, a - 16), a)) else 0.0) + (0.1 if recorded == category else 0.0)


def _latin_score(m: re.Match, s: str, whole: bool, strong: bool, after: bool) -> float:
    words = re.split(r"[ ,]+", m[0])
    if any(w in _NOT_NAMES or w in _STREETS for w in (words[:-1] if words[-1] in _KO_LATIN else words)):
        return 0.0
    if m["up"]:
        return 0.9 if words[0] in _KO_LATIN_UP else 0.0
    if m["last"]:
        return 0.8 if whole else 0.0
    known = words[-1] in _KO_LATIN or words[0].lower() in GIVEN_NAMES
    return 0.9 if whole or strong or after else 0.55 if known else 0.3


def propose(text: str, header: str = "", recorded: str = "") -> list[tuple[str, int, int, float]]:
    """(category, start, end, score) over the skeleton's characters, not yet resolved."""
    s = text
    out: list[tuple[str, int, int, float]] = []
    add = lambda cat, a, b, score: out.append((cat, a, b, score + _near(cat, s, a, header, recorded)))
    runs = _RE_DIGITS.findall(s)
    longest = max(map(len, runs), default=0)
    if longest >= 6:
        for m in RE_RRN.finditer(s):
            d = m[1] + m[2]
            if birth_ok(d):
                # The 7th digit is sex and century; 5 to 8 are foreign residents.
                a, b = m.span()
                # Ways to be sure: the check digit, the dash, a cell of its own, brackets after a name.
                alone = _whole(s.strip(" ,.:;/()"), m[0]) or s[max(0, a - 1) : a] == "("
                score = 0.35 + 0.3 * mod11_ok(d) + 0.3 * (b - a > 13) + 0.2 * alone
                add("foreign_id" if m[2][0] in "5678" else "rrn", a, b, 0.0 if m[2][0] == "0" else min(score, 0.85))
        if "-" in s:
            for m in RE_DRIVER.finditer(s):
                add("driver", *m.span(), 0.85)
        for m in RE_PASSPORT.finditer(s) if longest >= 8 else ():
            add("passport", *m.span(), 0.6)
    if longest >= 2:
        if "0" in s or "+" in s:
            for m in RE_TEL.finditer(s):
                n = sum(c.isdigit() for c in m[0])
                if 9 <= n <= 15 and ("-" in m[0] or " " in m[0] or "." in m[0] or _near("tel", s, m.start(), header, recorded) or len(m[0]) == len(s.strip())):
                    add("tel", *m.span(), 0.65)
        for m in RE_TEL_US.finditer(s) if longest >= 4 else ():
            add("tel", *m.span(), 0.6)
        for m in RE_CARD.finditer(s) if longest >= 4 else ():
            if luhn_ok(re.sub(r"\D", "", m[0])):
                add("card", *m.span(), 0.75)
        for m in RE_IBAN.finditer(s) if longest >= 2 else ():
            if mod97_ok(m[0]):
                add("iban", *m.span(), 0.9)
    if longest >= 2 and "01" in s or "+82" in s or "공일" in s or longest >= 2 and "(1" in s:
        for m in RE_MOBILE.finditer(s):
            n = sum(c.isdigit() for c in m[0])
            if not n or 10 <= n <= 13:
                add("phone", *m.span(), 0.8)
    if runs:
        if _RE_ADDRESS_HINT.search(s):
            for m in RE_ADDRESS.finditer(s):
                score = 0.7 if m["admin"] else 0.35
                add("address", *m.span(), score if m["road"] or m["admin"] else 0.1)
        if ", " in s:
            for m in RE_ADDRESS_EN.finditer(s):
                add("address", *m.span(), 0.8 if m["street"] else 0.4)
    if _RE_AT.search(s):
        for m in RE_EMAIL.finditer(s):
            if len(re.split(r"[.\s\])]", m[0])[-1]) >= 2:
                add("email", *m.span(), 0.9)
    stripped = s.strip(" ,.:;/()")
    for m in RE_NAME.finditer(s):
        a, b = m.span()
        before = RE_STRONG_BEFORE.search(s, max(0, a - 14), a) is not None
        after = RE_STRONG_AFTER.match(s, b) is not None
        whole = _whole(stripped, m[0])
        if m[1]:
            rare = m[1][0] not in SURNAMES and m[1][:2] not in _COMPOUND
            # A rare family name, and most of all one whose last syllable could be a particle, may be any word.
            score = 0.6 if not rare else 0.1 if m[1][-1] in _RARE_ENDINGS else 0.3 + 0.2 * (recorded == "person")
            before = before or not rare and m[1][:2] not in _PLAIN and RE_TOPIC_BEFORE.search(s, max(0, a - 14), a) is not None
            if len(m[1]) == 3 and m[1][:2] in _PLAIN and m[1][2] in _ENDINGS:
                score = 0.45 if whole and recorded == "person" else 0.3
        else:
            score = 0.75 if whole else 0.35 if s[a] in _UNSURE else 0.4
            before = before or not whole and RE_BEFORE.search(s, max(0, a - 14), a) is not None and RE_AFTER.match(s, b) is not None
        add("person", a, b, score + 0.25 * (before or after))
    if _RE_CAPITAL.search(s):
        for m in RE_LATIN.finditer(s):
            a, b = m.span()
            before = RE_STRONG_BEFORE.search(s, max(0, a - 14), a) is not None
            after = RE_STRONG_AFTER.match(s, b) is not None or RE_BEFORE.search(s, max(0, a - 14), a) is not None and RE_AFTER.match(s, b) is not None
            add("person", a, b, _latin_score(m, s, _whole(stripped, m[0]), before, after))
    return out


def _whole(stripped: str, value: str) -> bool:
    """The text is this value and at most a particle."""
    return len(stripped) - len(value) <= 4 and stripped.startswith(value) and (len(stripped) == len(value) or stripped[len(value) :] in _PARTICLES)


def resolve(found: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int]]:
    """Proposals that reach the threshold; of overlapping ones the best score, then the longest, then the first."""
    if len(found) == 1:
        return [found[0][:3]] if found[0][3] >= THRESHOLD else []
    taken: list[tuple[str, int, int]] = []
    for cat, a, b, score in sorted(found, key=lambda x: (-(x[2] - x[1] >= 6) * (x[3] >= THRESHOLD) * (x[0] == "address"), -x[3], x[1] - x[2], x[1])):
        if score >= THRESHOLD and all(b <= y or a >= z for _, y, z in taken):
            taken.append((cat, a, b))
    return sorted(taken, key=lambda x: x[1])


def find(text: str | None, header: str | None = "", recorded: str | None = "") -> list[tuple[str, int, int]]:
    """(category, start, end) in ``text`` as stored, in order, not overlapping."""
    if not text:
        return []
    shown, starts, ends = skeleton(text)
    spans = resolve(propose(shown, header or "", (recorded or "").lower()))
    return spans if starts is None else [(c, starts[a], ends[b - 1]) for c, a, b in spans]


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with ``[CATEGORY]`` in the place of each span."""
    if not spans:
        return text
    out, at = [], 0
    for cat, a, b in spans:
        out += [text[at:a], f"[{cat.upper()}]"]
        at = b
    return "".join(out) + text[at:]


_SPANS = "array<struct<category:string,start_pos:int,end_pos:int>>"
_ARROW_SPANS = pa.list_(pa.struct([("category", pa.string()), ("start_pos", pa.int32()), ("end_pos", pa.int32())]))


def detect(rows: DataFrame, id_col: str, text_col: str, header: Column | None = None, recorded: Column | None = None) -> DataFrame:
    """Rows (row_id, category, start_pos, end_pos): every span of every text. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for batch in batches:
            ids, texts, headers, marks = (batch.column(i).to_pylist() for i in range(4))
            cols: tuple[list, list, list, list] = ([], [], [], [])
            for i, *key in zip(ids, texts, headers, marks, strict=True):
                if not key[0]:
                    continue
                key = tuple(key)
                spans = seen.get(key)
                if spans is None:
                    if len(seen) >= 50_000:  # a cache only: what falls out is found again
                        seen.clear()
                    spans = find(*key)
                    if len(key[0]) < 200:
                        seen[key] = spans
                for c, a, b in spans:
                    cols[0].append(i)
                    cols[1].append(c)
                    cols[2].append(a)
                    cols[3].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int32()), strict=True)], names=["row_id", "category", "start_pos", "end_pos"])

    none = F.lit("")
    src = rows.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text"), (none if header is None else F.coalesce(header, none)).alias("header"), (none if recorded is None else F.coalesce(recorded, none)).alias("recorded"))
    return src.filter(F.length("text") > 0).mapInArrow(run, "row_id long, category string, start_pos int, end_pos int")


def placeholders(rows: DataFrame, text_col: str, into: str, header: Column | None = None, recorded: Column | None = None) -> DataFrame:
    """``rows`` with a column ``into``: the text with typed placeholders; null stays null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, headers: pd.Series, marks: pd.Series) -> pd.Series:
        return pd.Series([redact(t, find(t, h, m)) if t else t for t, h, m in zip(texts, headers, marks, strict=True)], dtype=object)

    none = F.lit("")
    return rows.withColumn(into, run(F.col(text_col), none if header is None else F.coalesce(header, none), none if recorded is None else F.coalesce(recorded, none)))
