"""Word lists, patterns and tables that results depend on.

Patterns are given once in the syntax Java and Python share; UNI makes Java treat letter case and white space as Unicode.
"""

UNI = "(?iuU)"

#: White space and words by Unicode, as classes: much faster than \s under Java's Unicode flag.
SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The characters of SPACE.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: All but SPACE, said as ranges, ASCII first: Java tries every part of a negated class on each letter.
WORD = "[!-\\x84\\x00-\\x08\\x0e-\\x1b\\x86-\\x9f\\xa1-\\u167f\\u1681-\\u1fff\\u200b-\\u2027\\u202a-\\u202e\\u2030-\\u205e\\u2060-\\u2fff\\u3001-\U0010ffff]+"

QUERY_TOKEN = r"-?[0-9]+(?:\.[0-9]+)?|[a-z]+|[+\-*/=<>]"
ANSWER_ANCHOR = r"####\s*đáp\s*án\s*là\s*[:：]?\s*"
NUMBER = r"-?[0-9]+(?:[.,][0-9]+)?"
LATEX_ANSWER = r"-?[0-9]+\\sqrt\{[^{}]+\}|\\sqrt\{[^{}]+\}|-?[0-9]+\\frac\{[^{}]+\}\{[^{}]+\}|\\frac\{[^{}]+\}\{[^{}]+\}"
BOXED = r"\\boxed\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}"
_SAYS = r"(?:đáp án|câu trả lời)\s*là\s*[:：]?\s*"
#: (pattern, has a group, ignores case), tried in this order; the first one that is found counts.
VI_ANCHORS = (
    (_SAYS + r"(\\frac\{[^{}]+\}\{[^{}]+\})", True, True),
    (_SAYS + r"(\\sqrt\{[^{}]+\})", True, True),
    (ANSWER_ANCHOR + r"(\\frac\{[^{}]+\}\{[^{}]+\})", True, True),
    (ANSWER_ANCHOR + r"(\\sqrt\{[^{}]+\})", True, True),
    (_SAYS + f"({NUMBER})", True, True),
    (r"####đáp án là:\s*([^\n]*)", True, True),
    (_SAYS + r"([^\n]*)", True, True),
    (r"####\s*([^\n]*)", True, False),
    (r"####đáp án là:\s*", False, False),
    (r"####\s*", False, False),
    (r"Đáp án là\s*[:：]?", False, False),
    (r"Câu trả lời là\s*[:：]?", False, False),
)
EN_ANCHORS = ((rf"the answer is\s*[:：]?\s*({NUMBER})", True, True), (r"The answer is\s*[:：]?", False, False), (r"####", False, False))
#: Markers of the last-marker strategy.
MARKERS = (r"Đáp\s*án\s*là\s*[:：]?", r"Đáp\s*án\s*[:：]", r"Câu\s*trả\s*lời\s*là\s*[:：]?", r"Câu\s*trả\s*lời\s*[:：]", r"Đáp\s*số\s*là\s*[:：]?", r"Đáp\s*số\s*[:：]", r"The\s+answer\s+is\s*[:：]?", r"####\s*")
#: Any of them; the look at the first letter refuses most places at once.
ANY_MARKER = f"(?=[đĐcCtT#])(?:{'|'.join(MARKERS)})"
VOTE_ANSWER = r"(?:####\s*|đáp án là\s*[:：]?\s*|câu trả lời là\s*[:：]?\s*|\\boxed\{)+" + f"({NUMBER})"

ASY_BLOCK = r"(?is)\[asy\].*?(?:\[/asy\]|\z)"
FRACTION = r"\\(?:d|t)?frac\s*\{([^{}]+)\}\s*\{([^{}]+)\}"
COMPOUND_FRACTION = r"\\(?:d|t)?frac\s*\{[^{}]*[+\-*/=][^{}]*\}\s*\{[^{}]*[+\-*/=][^{}]*\}"
LATEX_COMMAND = r"\\([A-Za-z]+)"
INEQUALITY = r"\\(?:leq?|geq?|neq?|equiv)\b"
MATH_FUNCTION = r"\\(?:cos|sin|tan|log|ln|sqrt|pi|theta|alpha|beta|gamma|delta)\b"
#: Literal replacements in this order.
LATEX_LITERALS = ((r"\times", " * "), (r"\cdot", " * "), (r"\div", " / "), (r"\leq", " <= "), (r"\le", " <= "), (r"\geq", " >= "), (r"\ge", " >= "), (r"\neq", " != "), (r"\ne", " != "), (r"\equiv", " = "), (r"\pm", " ± "), (r"\pi", " pi "))
LATEX_FUNCTIONS = ("arccos", "arcsin", "arctan", "cos", "sin", "tan", "cot", "sec", "csc", "log", "ln")
GREEK = ("alpha", "beta", "gamma", "delta", "theta", "lambda", "mu", "phi", "omega")

TYPE_PRIORITY = {"GSM_Rephrased": 0, "GSM_AnsAug": 1, "MATH_Rephrased": 2, "MATH_AnsAug": 3, "GSM_FOBAR": 4, "MATH_FOBAR": 5, "GSM_SV": 6, "MATH_SV": 7}
DIGIT_WORDS = {"không": 0, "một": 1, "hai": 2, "ba": 3, "bốn": 4, "năm": 5, "sáu": 6, "bảy": 7, "tám": 8, "chín": 9, "mười": 10}
#: Words of text cleanup leave out "không", which mostly means "no".
TEXT_DIGIT_WORDS = {w: n for w, n in DIGIT_WORDS.items() if w != "không"}
MAGNITUDES = {"mươi": 10, "mười": 10, "trăm": 100, "nghìn": 1_000, "ngàn": 1_000, "triệu": 1_000_000, "tỷ": 1_000_000_000, "tỉ": 1_000_000_000}
ORDINAL_WORDS = ("thứ", "tháng", "ngày", "tuần", "lần")
TIME_UNITS = ("năm", "tháng", "tuần", "ngày", "giờ", "phút", "giây")
PROTECTED_PAIRS = {"bậc": ("một", "hai", "ba", "bốn", "năm"), "loại": ("một", "hai", "ba", "bốn"), "hạng": ("một", "hai", "ba", "bốn"), "phần": ("trăm",)}
NOT_MULTIPLIED = ("viên", "vật", "dân", "loại", "tố", "lực", "chứng", "quyền", "giống", "tạo", "bản", "từ", "điển", "ái", "đức", "nghĩa", "hậu")
NOT_DIVIDED = ("sẻ", "tay", "rẽ", "cắt", "lửa", "buồn", "vui", "ngọt")

PROMPT = "Câu hỏi: {q}\nGiải:\n"
REQUIRED_FIELDS = ("id", "query_vi", "type", "model_output")

#: How built targets begin.
TARGET_ANCHOR = "####đáp án là:"
PROGRAM_STEP = r"(?m)^(?:s|step_)\d+\s*="
