"""Word lists. Fixed values, as text in natural order; operators take them as parameters or look them up here."""

from __future__ import annotations

# The label that a category's pseudonyms carry; letters follow the first three, numbers the others.
LABELS = {"person": "연구자", "org": "기관", "dept": "부서"}
NUMBERED = {
    "rrn": "주민등록번호", "foreign_id": "외국인등록번호", "passport": "여권번호", "driver": "운전면허번호", "phone": "휴대전화", "tel": "유선전화", "email": "이메일", "card": "카드번호", "account": "계좌번호", "address": "주소",
    "birth": "생년월일", "vehicle": "차량번호", "handle": "계정", "title": "직위", "bizno": "사업자등록번호", "corpno": "법인등록번호", "project_no": "과제번호", "budget": "예산", "confidential": "기밀",
}
# Header words by category.
HEADERS = {
    "person": "성명|성 명|이름|연구자명|연구책임자|책임자|담당자|작성자|신청인|대표자|성명(한글)|참여연구원|연구원명|성명및직위|위원명|발표자|저자|실무자|연락담당자",
    "org": "소속|소 속|기관|기관명|소속기관|근무처|회사|소속기관명|참여기관|주관기관|수행기관|협력기관|소속및직위",
    "dept": "부서|부서명|소속부서|팀|부서(팀)|학과|전공|학부",
    "title": "직위|직급|직책|직위(직급)|현직위",
    "phone": "연락처|전화|전화번호|휴대전화|휴대폰|핸드폰|연락처(휴대전화)|비상연락처|전화(휴대)",
    "email": "이메일|메일|전자우편|e-mail|email|이메일주소",
    "birth": "생년월일|생일|출생일|생년|생년월일(6자리)",
    "address": "주소|자택주소|주소지|소재지|우편물주소",
    "rrn": "주민등록번호|주민번호|주민등록번호앞자리|생년월일및성별",
}
HEADER_CATEGORY = {label: category for category, labels in HEADERS.items() for label in labels.split("|")}
# Organisation endings, words that end like one but are none, and company marks.
ORG_ENDINGS = "대학교 대학 연구원 연구소 연구단 재단 공사 공단 진흥원 협회 학회 센터 위원회 본부 사업단 법인 연구회 기술원 과학원 박물관 병원 초등학교 중학교 고등학교 대학원 유치원 어린이집 평가원 개발원 연수원 교육원 정보원 관리원 감독원 인증원 시험원 표준원 품질원 안전원 보건원 의료원 감사원 학술원 번역원 문화원 법원 보호원 한림원 소비자원 검역원 수련원 훈련원 예술원 국악원 테크노파크 보건소 연구실 지원단 협력단"
ORG_SHORT_ENDINGS = "부 처 청 국"
ORG_ABBREVIATIONS = "화학연 기계연 재료연 표준연 생명연 에너지연 에기연 원자력연 항우연 전기연 철도연 건설연 지질연 지자연 천문연 생기원 식품연 김치연 한의학연 핵융합연 안전성연 기초지원연 과기연 전자통신연 국보연 카이스트 포스텍 유니스트 지스트 디지스트 켄텍"
ORG_NOT = "참여연구원 책임연구원 선임연구원 수석연구원 공동연구원 주관연구원 전담연구원 위촉연구원 학생연구원 연구원 연구소 연구단 대학교 대학 센터 본부 재단 협회 학회 위원회 사업단 기술원 국가연구개발사업 정부출연연구기관 출연연구기관 박사후연구원 연구보조원 대학원 일반대학원 특수대학원 전문대학원 공동연구실 개인연구실 학생연구실 교수연구실 대학원연구실 기업부설연구실"
ORG_ROLES = "박사후 연구보조 책임 선임 수석 주임 참여 공동 주관 전담 위촉 학생 초빙 객원 겸임 전임 비전임 전문 일반 신진 청년 여성 우수 핵심 보조 행정 기술 석사 박사 인턴 파견 계약직 정규직 비정규직 해외 국내 외부 내부 소속"
ORG_LATIN = "KAIST POSTECH UNIST GIST DGIST KENTECH UST KIST ETRI KRICT KIMM KIMS KRISS KRIBB KIER KAERI KARI KERI KRRI KICT KIGAM KASI KITECH KFRI KIOM KFE KBSI KISTI"
COMPANY_CUES = "스타트업 벤처기업 벤처 기업 회사 업체 법인 자회사 모회사 협력사 컨소시엄"
# Particles that may follow a name, and those of them that may follow a title.
PARTICLES = "은 는 이 가 을 를 와 과 의 도 만 께 에게 에게서 한테 부터 까지 으로 로 이며 이고 이다 입니다 이라 라고 님 씨 등 및 외 께서 에서 에 이나 랑 이랑 처럼 보다"
NAME_PARTICLES = "께서 에게서 에게 한테 부터 까지 으로 이며 이고 이다 입니다 이라고 이라 라고 에서 이나 이랑 처럼 보다 은 는 이 가 을 를 와 과 의 도 만 께 로 에 랑"
HONORIFICS = "언니 오빠 누나 형 선배 후배 쌤 선생님 씨 님 군 양"
TITLES = "교수 부교수 조교수 박사 석사 연구원 책임연구원 선임연구원 수석연구원 연구위원 위원장 위원 부장 차장 과장 팀장 실장 본부장 센터장 소장 원장 총장 학장 대표 이사 사장 회장 국장 처장 관장 감사 주무관 사무관 서기관 선생 선생님 박사님 교수님 책임 선임 수석 단장 부단장 부원장 부소장 부총장 부회장 부사장 이사장 대표이사 전무 상무 고문 지점장 그룹장 파트장 사무국장 연구관 연구사 장관 차관 의원 시장 군수 구청장 지사 간사 대리 주임 조교 강사 변호사 기자 명예교수 석좌교수 연구교수 겸임교수 초빙교수 학생 사원"
# Titles that often stand for something else than a person, and roles that stand before a name.
WEAK_TITLES = "시장 지사 의원 감사 이사 대리 주임 고문 간사 강사 기자 책임 선임 수석 군수 석사"
ROLES = "박사후연구원 연구보조원 학생연구원 위촉연구원 석사과정 박사과정 통합과정 학부연구생 학부생 대학원생 석사과정생 박사과정생 인턴 연구생 수련생"
# Labels in running text after which a person's name stands.
PERSON_LABELS = "참석자 참석 불참자 불참 배석자 배석 발표자 발표 토론자 토론 사회자 사회 기록자 기록 검토자 작성자 면접자 면담자 응답자 보낸사람 받는사람 발신자 발신 수신자 예금주 담당자 담당 문의 연락 협조자 기안자 기안 결재 확인자 작성"
SURNAMES = "김이박최정강조윤장임한오서신권황안송류유홍전고문손양배백허남심노하곽성차주우구민진지엄채원천방공현함변염여추도소석선설마길위표명기반왕금옥육인맹제탁국빈동온사시경부계봉나라연모용은어예편복가태목두피감음좌간범승팽갈견단상옹"
SURNAMES_2 = "남궁 황보 제갈 사공 선우 서문 독고 동방 망절 무본 부여 소봉 어금 장곡"
UNSURE_SURNAMES = "이한주강안고구인양부전현모제두단나국시도여명동"
# Lines after which a document lists its references.
REFERENCES = "참고문헌 References 인용문헌 참고자료"
# Pseudonyms.
PSEUDONYM = r"\[[가-힣A-Za-z]+?(?:[A-Z]+|\p{Nd}+)(?:-[가-힣A-Za-z]+\p{Nd}*)?\]"
# Categories of each risk level.
CRITICAL = "rrn foreign_id card account passport driver"
HIGH = "person phone tel email address birth vehicle handle"
# Detectors in order of trust.
RANKS = {"rule": 0, "L1": 1, "L2": 2, "L3": 3, "L4": 4}


def alternation(words: str) -> str:
    """The words as a pattern, longest first."""
    return "|".join(sorted(words.split(), key=len, reverse=True))
