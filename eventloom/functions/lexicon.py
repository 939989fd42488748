"""Word lists and patterns of the text rules."""

# Korean news words that tell events apart badly, and what else the
# rules compare with.  They must be these for the results to be right.
STOPWORDS = (
    "기자", "뉴스", "단독", "종합", "속보", "오늘", "내일", "오전", "오후",
    "관련", "통해", "대해", "대한", "위해", "이번", "지난", "올해", "내년",
    "밝혔다", "전했다", "설명했다", "말했다", "따르면", "제공", "진행",
    "발표", "공개", "추진", "운영", "지원", "확대", "강화", "개최",
    "서비스", "사업", "기업", "업계", "시장", "정부", "기관", "서울",
)
CLUSTER_STOPWORDS = (*STOPWORDS, "한국", "국내", "글로벌", "최신", "주요", "확인", "가능", "기준")
HISTORY_STOPWORDS = (*CLUSTER_STOPWORDS, "기반", "활용", "도입", "사용", "운용", "참여", "소개")
ANCHOR_STOPWORDS = (
    *HISTORY_STOPWORDS,
    "ai", "it", "ict", "dx", "si", "emr", "시스템", "기술", "산업",
    "플랫폼", "솔루션", "정보", "디지털",
)
WEAK_ANCHORS = (
    *ANCHOR_STOPWORDS,
    "경제", "경제학상", "노벨경제학상", "대통령", "부총리", "장관",
    "부동산", "부동산시장", "주택시장", "증시", "뉴욕증시", "코스피", "코스닥",
    "나스닥", "다우", "다우지수", "정상회담", "미중회담", "트럼프", "시진핑",
    "15일", "14일", "현지시간", "연합뉴스", "주식", "투자자",
)
# Particles that end a word; the first that fits goes.
PARTICLES = (
    "으로부터", "로부터", "에서는", "에게서", "까지", "부터", "처럼", "보다",
    "으로", "라고", "하고", "에서", "에게", "에도", "에는", "만큼",
    "은", "는", "이", "가", "을", "를", "의", "에", "와", "과", "도", "만", "로",
)
HANJA = {"美": "미국", "韓": "한국", "中": "중국", "日": "일본", "李": "이", "金": "김"}
ENTITY_ALIASES = {
    "sk ax": "skax",
    "sk㈜ c&c": "skax",
    "sk c&c": "skax",
    "에스케이 ax": "skax",
    "에스케이 씨앤씨": "skax",
    "오픈ai": "openai",
    "오픈 ai": "openai",
    "open ai": "openai",
    "챗gpt": "chatgpt",
    "chat gpt": "chatgpt",
    "경복대학교": "경복대",
    "롯데 홈쇼핑": "롯데홈쇼핑",
    "태광 산업": "태광산업",
    "메가존 클라우드": "메가존클라우드",
    "아이티센 글로벌": "아이티센글로벌",
    "차 바이오텍": "차바이오텍",
    "ai디지털 헬스케어": "ai디지털헬스케어",
    "ai 디지털 헬스케어": "ai디지털헬스케어",
    "경기도": "gyeonggi",
    "풍수해대책": "풍수해",
    "재난대응체계": "대응체계",
    "첨단 재난대응체계": "대응체계",
}
ACTIONS = (
    "협력", "제휴", "파트너십", "동맹", "계약", "공급", "선정", "수주",
    "인수", "매각", "투자", "출시", "개설", "신설", "구축", "도입",
    "갱신", "인증", "해임", "부결", "갈등", "분쟁", "실적", "영업이익",
    "영업손실", "매출", "수출", "대응", "점검", "재편", "개최",
    "합류", "가동", "대비", "진행", "선보",
)
ACTION_ALIASES = {
    "파트너십": "협력", "제휴": "협력", "동맹": "협력", "협력": "협력", "합류": "협력", "계약": "협력",
    "진행": "개최", "선보": "출시", "개설": "신설", "신설": "신설", "선정": "선정", "공급": "공급",
    "수주": "수주", "구축": "대응", "대응": "대응", "가동": "대응", "대비": "대응", "해임안": "해임",
    "해임": "해임", "부결": "부결", "갈등": "갈등", "분쟁": "갈등", "실적": "실적", "영업이익": "실적",
    "영업손실": "실적", "매출": "실적",
}
WEAK_ACTIONS = ("협력", "투자", "대응", "공급", "점검", "개최", "실적", "수출", "출시")
QUERY_PARAMS = ("no", "idxno", "article_no", "articleid", "article_id", "newsid", "news_id", "aid", "oid", "sid", "id", "seq", "num")
PHOTO_URLS = ("/photos/", "/photo/", "NISI")
PHOTO_TITLES = (
    "참석하는", "주재하는", "발언하는", "모두 발언", "모두발언", "기념촬영",
    "손드는", "이동하는", "입장하는", "대화하는", "자료 살펴보", "브리핑하는",
)
BREAKING_TITLES = ("[속보]", "[1보]", "[2보]", "[외환]", "[달러·원]")
HOST_SUFFIXES = (".co.kr", ".or.kr", ".go.kr", ".ac.kr", ".com", ".net", ".org", ".kr")
UNKNOWN_PUBLISHER = "언론사 미상"
PUNCTUATION = "[“”‘’\"'`~!@#$%^&*()_+=\\[\\]{};:,.<>/?\\\\|《》〈〉·ㆍ-]"
