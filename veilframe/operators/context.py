"""People, organisations and departments told by what stands around them. One text at a time, plain Python.

A text is cut into words of Hangul and of Latin letters; a name is a word (or a row of capitalised words) whose
neighbours say so: a label before it, a title after it, a heading above it. What has been taken by an earlier kind of
clue is not taken again. What only the whole document can decide - whose surname it is, which names are registered -
is decided in :mod:`veilframe.operators.documents`.
"""

from __future__ import annotations

import re

from veilframe.functions.lexicon import (
    COMPANY_CUES, HEADER_CATEGORY, HEADERS, HONORIFICS, NAME_PARTICLES, ORG_ABBREVIATIONS, ORG_ENDINGS, ORG_LATIN, ORG_NOT, ORG_ROLES, ORG_SHORT_ENDINGS, PARTICLES, PERSON_LABELS, PSEUDONYM, REFERENCES, ROLES, SURNAMES,
    SURNAMES_2, TITLES, UNSURE_SURNAMES, WEAK_TITLES,
)

CERTAIN, LIKELY = "확실", "추정"
Found = tuple[int, int, str, str, str]
# Notes.
NOTE_PROPAGATED, NOTE_LABEL, NOTE_PAYEE, NOTE_LATIN, NOTE_SOUND = "대장 전파", "이름표 뒤 이름", "예금주", "영문 이름", "음역 이름"
NOTE_LINKED, NOTE_LOCAL, NOTE_UNLINKED, NOTE_GIVEN = "성+직함 (대장 연결)", "성+직함 (본문 성명 연결)", "성+직함 (미연결)", "이름만 부른 표기"
NOTE_ENDING, NOTE_COMPANY, NOTE_QUOTED, NOTE_OFFICE, NOTE_SHORT, NOTE_ENGLISH, NOTE_DEPT, NOTE_STEM = "기관 접미사", "회사 표시", "따옴표 회사 이름", "지방 관서", "기관 약칭", "영문 기관", "기관 뒤 학과·부서", "대학 약칭"
# Marks before Latin names and English words that no person's name holds.
ADDRESS_FORMS = "Prof Professor Dr Mr Ms Mrs"
MAIL_LABELS = "From To Cc 보낸사람 받는사람"
NOT_IN_NAMES = "University Institute College Laboratory Lab Labs Center Centre Council Agency Ministry Department School Corp Inc Company Foundation Association System Program Project National International Research Technology Science Sciences Policy Innovation Advanced Global Korea Korean"
ENGLISH_KINDS = "University Institute College Laboratory Laboratories"
LOCAL_UNITS, LOCAL_OFFICES = "시 군 구 도", "보건소 시청 군청 구청 도청 교육청 교육지원청 경찰서 소방서 세무서 우체국 주민센터 행정복지센터 의회"
COMPANY_MARKS = "㈜ (주) 주식회사"
DEPT_ENDINGS = "학과 학부 전공 연구단 센터 본부 산학협력단 사업단 교실 연구실"
DEPT_NOT = "연구팀 연구실 연구단 연구부 사업단 본부 센터 소속 출신 내부 외부 전체 일부 전부 간부 직원 관계자 담당자 대학"
UNIVERSITY = "대학교"
# Fixed value: names of under this many syllables count only beside surer ones.
SHORT_NAME, LEAST_ORG, LONGEST_NAME = 2, 3, 5

_words = lambda s: frozenset(s.split())
_TITLES, _WEAK, _ROLES, _FORMS = _words(TITLES), _words(WEAK_TITLES), _words(ROLES), _words(ADDRESS_FORMS)
_STRONG = (_TITLES - _WEAK) | {"씨"}
_S2 = _words(SURNAMES_2)
_TAILS = tuple(sorted(_words(NAME_PARTICLES), key=len, reverse=True))
_ENDS = tuple(sorted(_words(ORG_ENDINGS), key=len, reverse=True))
_ORG_NOT, _ORG_ROLES = _words(ORG_NOT), tuple(_words(ORG_ROLES))
_NOT_NAMES = _words(NOT_IN_NAMES)
_HANGUL = re.compile("[가-힣]+")
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-ÞĀ-Ž][a-zß-öø-ÿā-ž']*\.?")
_PSEUDONYM = re.compile(PSEUDONYM.replace(r"\p{Nd}", r"\d"))
_alt = lambda words: "|".join(map(re.escape, sorted(words, key=len, reverse=True)))


def free(found: list[Found], taken: list[Found]) -> list[Found]:
    return [f for f in found if not any(f[0] < t[1] and t[0] < f[1] for t in taken)]


def surname_of(name: str) -> str:
    """The family name a Hangul name begins with, or ''."""
    return name[:2] if name[:2] in _S2 and len(name) > 2 else name[:1] if name[:1] in SURNAMES else ""


def name_shape(word: str) -> bool:
    """A family name and one or two syllables (compound ones: and one to two)."""
    s = surname_of(word)
    return bool(s) and 1 <= len(word) - len(s) <= 2


def given_of(name: str) -> str | None:
    """The two syllables after the family name."""
    s = surname_of(name)
    return name[len(s) :] if s and len(name) - len(s) == 2 else None


def looks_like_name(value: str) -> bool:
    return latin_name(value) or 2 <= len(value) <= LONGEST_NAME and _HANGUL.fullmatch(value) is not None


def latin_name(value: str) -> bool:
    """Two to four capitalised words."""
    words = value.split(" ")
    return 2 <= len(words) <= 4 and all(re.fullmatch(r"[A-ZÀ-ÖØ-ÞĀ-Ž][A-Za-zÀ-ž.'\-]+", w) for w in words)


def has_pseudonym(value: str) -> bool:
    return "[" in value and _PSEUDONYM.search(value) is not None


def header_category(header: str | None) -> str | None:
    """Category of a header: of the whole, without blanks or bracket signs, else of its last word that has one."""
    if not header:
        return None
    whole = re.sub(r"\s+", "", header)
    for h in (whole, re.sub(r"[()（）\[\]]", "", whole)):
        if h in HEADER_CATEGORY:
            return HEADER_CATEGORY[h]
    return next((HEADER_CATEGORY[w] for w in reversed(re.split(r"[\s()（）\[\]/·,]+", header)) if w in HEADER_CATEGORY), None)


# ---- structure


#: Headers under which the cell itself is not a finding: numbers and mail are told by their shape.
_NO_CELL = frozenset(("title", "phone", "email"))


def cell(text: str, header: str | None, is_header: bool) -> list[Found]:
    """The cell that its header names."""
    category = None if is_header else header_category(header)
    value = text.strip()
    if category is None or category in _NO_CELL or len(value) < 2 or has_pseudonym(value) or category == "person" and not looks_like_name(value):
        return []
    a = text.index(value)
    return [(a, a + len(value), category, CERTAIN, f"표 머리글 '{header.strip()}'")]


def harvest(text: str, header: str | None, is_header: bool) -> list[tuple[str, str]]:
    """(category, name) that a cell under a header or a label gives to the document's registry."""
    out = []
    category = None if is_header else header_category(header)
    value = text.strip()
    if category in ("person", "org", "dept") and value and not has_pseudonym(value):
        if category == "person":
            out += [(category, value)] if latin_name(value) else [(category, w) for w in _HANGUL.findall(value) if looks_like_name(w)]
        elif category == "dept" or len(value) >= LEAST_ORG:
            out.append((category, value))
    return out + labelled(text)


_LABEL = {label: c for c in ("person", "org", "dept") for label in HEADERS[c].split("|")}
_LABELLED = re.compile(rf"({_alt(_LABEL)})\s*[:：]\s*([^\s,，/|]{{2,20}})")


def labelled(text: str) -> list[tuple[str, str]]:
    """(category, value) after a label for people, organisations or departments."""
    if ":" not in text and "：" not in text:
        return []
    out = []
    for m in _LABELLED.finditer(text):
        category, value = _LABEL[m[1]], m[2]
        if not has_pseudonym(value) and (looks_like_name(value) and name_shape(value) if category == "person" else len(value) >= LEAST_ORG):
            out.append((category, value))
    return out


# ---- people


def _rows_of_capitals(text: str) -> list[tuple[int, int]]:
    """Stretches of two to four capitalised words, single blanks or hyphens between them, the first of two letters or more."""
    out, run = [], []
    for m in _CAPITAL.finditer(text):
        glued = run and text[run[-1][1] : m.start()] in (" ", "-")
        inside = m.start() and text[m.start() - 1].isalpha()
        if inside or not glued:
            if len(run) > 1:
                out.append(run)
            run = []
        if not inside and (run or len(m[0].rstrip(".")) > 1) and len(run) < 4:
            run.append(m.span())
    if len(run) > 1:
        out.append(run)
    return [(r[0][0], r[-1][1] - (text[r[-1][1] - 1] == ".")) for r in out]


def _title_at(text: str, at: int, bracket: bool = True, names: frozenset[str] = _STRONG) -> bool:
    """A title, with a particle at most, begins at ``at`` after blanks or a closing bracket."""
    if bracket and text[at : at + 1] == ")":
        at += 1
    while text[at : at + 1].isspace():
        at += 1
    m = _HANGUL.match(text, at)
    if not m:
        return False
    word = m[0]
    for tail in ("", *_TAILS):
        if word.endswith(tail):
            stem = word[: len(word) - len(tail)]
            if stem in names or stem.endswith("님") and stem[:-1] in names:
                return True
    return False


def cited(text: str) -> list[tuple[int, int]]:
    """Citations: a bracket that ends in a year, and names before a bracketed year."""
    out = []
    for m in re.finditer(r"\(([^()]*)\)", text):
        inner = m[1]
        if re.search(r"\d{4}[a-z]?(?:\s*[:,]\s*(?:pp?\.\s*)?[\d\-–]+)?$", inner) and len(inner) <= 90:
            start = m.start()
            if re.fullmatch(r"\d{4}[a-z]?", inner):
                names = re.search(r"(?:[가-힣]{2,4}\s?[·,와과]\s?)*[가-힣]{2,4}(?:\s*(?:외|등))?(?:\s*\d+\s*인)?\s*$", text[:start])
                start = names.start() if names else start
            out.append((start, m.end()))
    return out


_INLINE = re.compile(rf"(?<![가-힣A-Za-z])(?:{_alt(PERSON_LABELS.split())})[  　]*[:：][  　]*")
_PAYEE = re.compile(r"예금주[  　]*[:：]?[  　]*([가-힣]{2,4})(?![가-힣])")


def listed(text: str) -> list[Found]:
    """Names in the list after a label. Two-syllable ones only alone in their place and beside two longer ones."""
    out: list[Found] = []
    if ":" in text or "：" in text:
        for label in _INLINE.finditer(text):
            stop = re.search(r"[\t\n/|;；]", text[label.end() :])
            end = label.end() + stop.start() if stop else len(text)
            # What stands in brackets is an office or address; it is blanked, so that places hold.
            body = re.sub(r"\([^()]*\)|<[^<>]*>|\[[^\[\]]*\]", lambda e: " " * len(e[0]), text[label.end() : end])
            sure, short, at = [], [], label.end()
            for piece in re.split("([,，、])", body):
                words = [m for m in _HANGUL.finditer(piece) if m[0] not in _TITLES and m[0] not in _ROLES]
                for m in words:
                    span = (at + m.start(), at + m.end(), "person", LIKELY, NOTE_LABEL)
                    if not name_shape(m[0]):
                        continue
                    if len(m[0]) > SHORT_NAME:
                        sure.append(span)
                    elif len(words) == 1:
                        short.append(span)
                at += len(piece)
            out += sure + (short if len(sure) >= 2 else [])
    if "예금주" in text:
        payees = [(*m.span(1), "person", LIKELY, NOTE_PAYEE) for m in _PAYEE.finditer(text) if name_shape(m[1])]
        out += free(payees, out)
    return out


_BEFORE_LATIN = re.compile(rf"(?<![A-Za-z])(?:{_alt(_FORMS)})\.?[  　]+$")
_MAIL_BEFORE = re.compile(rf"(?<![A-Za-z가-힣])(?:{_alt(MAIL_LABELS.split())}|보낸 사람|받는 사람)[  　]*[:：][  　]*\"?$")
_ROLE_BEFORE = re.compile(rf"(?<![가-힣])(?:{_alt(_STRONG | _ROLES)})[  　]+$")
_HANGUL_BEFORE = re.compile(r"(?:[가-힣]{2,6} )?[가-힣]{2,6}(?= ?\($)|[가-힣]{2,6}(?= ?\($)")


def latin(text: str) -> list[Found]:
    """Latin names after a form of address, before a Korean title, after a mail label or a role; the Hangul form before a bracketed one with a title."""
    kinds: tuple[list[Found], ...] = ([], [], [], [])
    sounds = []
    for a, b in _rows_of_capitals(text):
        words = re.split("[ -]", text[a:b])
        if words[0].rstrip(".") in _FORMS and len(words) > 2:
            a += len(words[0]) + 1
            words = words[1:]
        if any(w.rstrip(".") in _NOT_NAMES for w in words):
            continue
        here = (a, b, "person", LIKELY, NOTE_LATIN)
        before = text[max(0, a - 24) : a]
        if _BEFORE_LATIN.search(before):
            kinds[0].append(here)
        elif _title_at(text, b + (text[b : b + 1] == ".")):
            kinds[1].append(here)
            if before.endswith("("):
                m = re.search(r"((?:[가-힣]{2,6}[  　])?[가-힣]{1,6})[  　]?\($", text[:a])
                if m and 2 <= len(m[1].split()[0]):
                    sounds.append((m.start(1), m.end(1), "person", LIKELY, NOTE_SOUND))
        elif _MAIL_BEFORE.search(before):
            kinds[2].append(here)
        elif _ROLE_BEFORE.search(before):
            kinds[3].append(here)
    out: list[Found] = []
    for k in (*kinds, sounds):
        out += free(k, out)
    return out


def surname_titles(text: str) -> list[tuple[int, int, str]]:
    """(start, end, surname) of a family name with a title right after it: '김 박사'."""
    out = []
    for m in _HANGUL.finditer(text):
        word, a = m[0], m.start()
        if word in _TITLES:
            continue
        for s in (word[:2], word[:1]):
            if s in _S2 or len(s) == 1 and s in SURNAMES:
                rest = word[len(s) :]
                at = a + len(s)
                if rest and _title_at(text, at, False, _TITLES) or not rest and text[at : at + 1].isspace() and _title_at(text, at + 1, False, _TITLES) and not text[at + 1 : at + 2].isspace():
                    out.append((a, at, s))
                    break
    return out


def unsure_surname(s: str) -> bool:
    """A family name that is an everyday word as well."""
    return len(s) == 1 and s in UNSURE_SURNAMES


def people(text: str) -> list[Found]:
    """Names whose neighbours in the text tell them; none inside a citation, but for those after a label."""
    out = listed(text)
    others = latin(text)
    if others:
        where = cited(text)
        out += free([o for o in others if not any(a <= o[0] and o[1] <= b for a, b in where)], out)
    return sorted(out)


# ---- organisations


def _without_tail(word: str) -> list[str]:
    """The word, and what it is without a particle."""
    return [word, *(word[: -len(t)] for t in sorted(_words(PARTICLES), key=len) if word.endswith(t) and len(word) > len(t) + 1)]


def _is_role(word: str) -> bool:
    return word.endswith("연구원") and word[:-3].endswith(_ORG_ROLES)


def _by_ending(text: str) -> tuple[list[Found], list[Found]]:
    long, short = [], []
    for m in re.finditer("[가-힣A-Za-z0-9]+", text):
        if not ("가" <= m[0][-1] <= "힣"):
            continue
        for word in _without_tail(m[0]):
            hit = next((e for e in _ENDS if word.endswith(e) and 1 <= len(word) - len(e) <= 14), None)
            if hit:
                if word not in _ORG_NOT and not _is_role(word) and not word.endswith("정부"):
                    long.append((m.start(), m.start() + len(word), "org", LIKELY, NOTE_ENDING))
                break
            if word[-1] in ORG_SHORT_ENDINGS.split() and 4 <= len(word) <= 16 and word == m[0] and _HANGUL.fullmatch(word):
                short.append((m.start(), m.end(), "org", LIKELY, NOTE_ENDING))
                break
    return long, short


_MARKED = re.compile(r"(?:㈜\s?|\(주\)\s?|주식회사\s)([가-힣A-Za-z0-9]{2,14})")
_MARK_AFTER = re.compile(r"[가-힣A-Za-z0-9]{2,14}(?:\s?(?:㈜|\(주\))(?!\s?[가-힣A-Za-z0-9])|(?:㈜|\(주\)))")
_QUOTED = re.compile(rf"(?:{_alt(COMPANY_CUES.split())})[  　]*(?P<q>['‘\"“])([^'’\"”\t\n]{{2,15}})['’\"”]")
_OFFICE = re.compile(rf"(?<![가-힣])[가-힣]{{2,5}}(?:{_alt(LOCAL_UNITS.split())})[  　]?(?:{_alt(LOCAL_OFFICES.split())})")


def english_orgs(text: str) -> list[Found]:
    """English institutions: 'X University of Y', 'University of X', 'UC X'."""
    out = []
    words = [(m[0], *m.span()) for m in re.finditer("[A-Za-z]+", text)]
    capital = lambda w: w[0].isupper() and len(w) > 1 and not w.isupper()
    i = 0
    while i < len(words):
        w = words[i][0]
        next_to = lambda j: j < len(words) and text[words[j - 1][2] : words[j][1]] in (" ", ", ")
        j = None
        if w == "University" and next_to(i + 1) and words[i + 1][0] == "of" and next_to(i + 2) and capital(words[i + 2][0]):
            j = i + 2
            for _ in range(2):
                if next_to(j + 1) and capital(words[j + 1][0]):
                    j += 1
        elif w == "UC" and next_to(i + 1) and capital(words[i + 1][0]):
            j = i + 1 + (next_to(i + 2) and capital(words[i + 2][0]))
        elif capital(w):
            for k in range(i + 1, i + 4):
                if not (k < len(words) and text[words[k - 1][2] : words[k][1]] == " " and capital(words[k][0])):
                    break
                if words[k][0] in ENGLISH_KINDS.split():
                    j = k
            if j and next_to(j + 1) and words[j + 1][0] in ("of", "for") and next_to(j + 2) and capital(words[j + 2][0]):
                j += 2
                if next_to(j + 1) and words[j + 1][0] == "and" and next_to(j + 2) and capital(words[j + 2][0]):
                    j += 2
                if next_to(j + 1) and text[words[j][2] : words[j + 1][1]] == " " and capital(words[j + 1][0]):
                    j += 1
        if j:
            out.append((words[i][1], words[j][2], "org", LIKELY, NOTE_ENGLISH))
            i = j
        i += 1
    return out


_LATIN_SHORT = _words(ORG_LATIN)
_HANGUL_SHORT = _words(ORG_ABBREVIATIONS)


def _abbreviations(text: str) -> list[Found]:
    out = [(*m.span(), "org", LIKELY, NOTE_SHORT) for m in re.finditer(r"(?<![A-Za-z0-9])[A-Z]{3,7}(?![A-Za-z0-9])", text) if m[0] in _LATIN_SHORT]
    for m in _HANGUL.finditer(text):
        word = next((w for w in _without_tail(m[0]) if w in _HANGUL_SHORT), None)
        if word:
            out.append((m.start(), m.start() + len(word), "org", LIKELY, NOTE_SHORT))
    return out


def organisations(text: str) -> list[Found]:
    """Organisations by ending, company mark, local office, quotes, abbreviation, English name and short ending, in that precedence."""
    long, short = _by_ending(text)
    out = list(long)
    if any(m in text for m in COMPANY_MARKS.split()):
        out += free([(*m.span(), "org", LIKELY, NOTE_COMPANY) for m in _MARK_AFTER.finditer(text)], out)
        out += free([(*m.span(1), "org", LIKELY, NOTE_COMPANY) for m in _MARKED.finditer(text) if not any(a <= m.start() < b for a, b, *_ in out)], out)
    kinds = [[(*m.span(), "org", LIKELY, NOTE_OFFICE) for m in _OFFICE.finditer(text)], [(*m.span(2), "org", LIKELY, NOTE_QUOTED) for m in _QUOTED.finditer(text)], _abbreviations(text), english_orgs(text), short]
    for k in kinds:
        if k is kinds[0]:  # the office is the longer name
            out = [o for o in out if not any(o[0] < f[1] and f[0] < o[1] for f in k)] + k
        else:
            out += free(k, out)
    return sorted(out)


def is_department(word: str) -> bool:
    """A word after an organisation that names a part of it. Endings of one syllable would need a morphological analyzer."""
    return word not in DEPT_NOT.split() and word not in _ROLES and word.endswith(tuple(DEPT_ENDINGS.split())) and len(word) > 2


def departments(text: str, at: int) -> list[Found]:
    """Up to two departments right after an organisation that ends at ``at``."""
    out = []
    for _ in range(2):
        m = re.compile(r"[  　]+([가-힣A-Za-z0-9]{2,15})").match(text, at)
        word = m and next((w for w in _without_tail(m[1]) if is_department(w)), None)
        if not word:
            break
        out.append((m.start(1), m.start(1) + len(word), "dept", LIKELY, NOTE_DEPT))
        at = m.start(1) + len(word)
        if len(word) < len(m[1]):
            break
    return out


def universities(text: str) -> list[str]:
    """Stems of the universities a text names: 누리 of 누리대학교."""
    return [m[1] for m in re.finditer(rf"(?<![가-힣])([가-힣]{{2,8}}){UNIVERSITY}", text)] if UNIVERSITY in text else []


def short_universities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, stem) of what may be a university's short form, 누리대."""
    return [(m.start(), m.end(), m[1]) for m in re.finditer(r"(?<![가-힣])([가-힣]{2,8}?)대(?!학)", text)] if "대" in text else []


def opens_references(text: str) -> bool:
    """A line that opens the list of references."""
    return re.match(rf"\s*#{{0,4}}\s*(?:{_alt(REFERENCES.split())})", text) is not None


# ---- words


_FOLLOWS = tuple(sorted(_words(PARTICLES) | _TITLES, key=len, reverse=True))


def is_word(text: str, a: int, b: int) -> bool:
    """A Hangul name at [a, b) stands as a word of its own, or before a particle or title."""
    if a and "가" <= text[a - 1] <= "힣" and "가" <= text[a] <= "힣":
        return False
    right = text[b : b + 8]
    return not right or not "가" <= right[0] <= "힣" or right.startswith(_FOLLOWS)


def given_name_hits(text: str, name: str) -> list[tuple[int, bool]] | None:
    """Places of a person's given name alone (start, explained); whole names are passed over.

    A place is explained by a title, a form of address or a particle after it and no syllable before it.
    """
    given = given_of(name)
    out = []
    at = text.find(given)
    while at >= 0:
        s = len(name) - 2
        if text[max(0, at - s) : at + 2] != name:
            tail = _HANGUL.match(text, at + 2)
            rest = tail[0] if tail else ""
            stems = {rest, rest.removeprefix("이")}
            fits = any(r == "" or r in _TAILS or r in _TITLES or r in HONORIFICS.split() for r in stems) or _title_at(text, at + 2, False) and not rest
            before = at and "가" <= text[at - 1] <= "힣"
            out.append((at, not before and fits))
        at = text.find(given, at + 1)
    return out
