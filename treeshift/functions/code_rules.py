"""How each language looks, as data.

A language is a row of regular expressions that the symbol job applies to
masked lines (comments gone, string literals reduced to ``""``); adding one
needs no code. Java regex syntax; repeated groups are possessive or unrolled,
because a backtracking group overflows the stack on a long match.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# -- literals and comments -----------------------------------------------------
# the closing quote is one with an even number of backslashes before it
_END = r"(?<!\\)(?:\\\\)*"
DOUBLE = rf'"[^\n]*?{_END}"'
SINGLE = rf"'[^\n]*?{_END}'"
DOUBLE_MULTI = rf'"(?s:.*?){_END}"'
SINGLE_MULTI = rf"'(?s:.*?){_END}'"
CHAR = r"'(?:\\(?:'|[^'\n]++)|[^'\\\n])'"


def _nested(opens: str, closes: str, run: str, depth: int) -> str:
    """A bracketed text, ``depth`` levels deep, with ``run`` between brackets."""
    text = rf"{opens}{run}{closes}"
    for _ in range(depth):
        text = rf"{opens}{run}(?:{text}{run})*+{closes}"
    return text


def _templates(depth: int) -> str:
    """A template literal whose ``${}`` hold braces, literals and ``depth`` levels of further templates."""
    text = r"`[^`\\]*+(?:\\(?s:.)[^`\\]*+)*+`"
    for _ in range(depth):
        run = rf"[^`{{}}\"']*+(?:(?:{DOUBLE}|{SINGLE}|{text})[^`{{}}\"']*+)*+"
        text = rf"`[^`\\$]*+(?:(?:\\(?s:.)|\${_nested('\\{', '\\}', run, 1)}|\$(?!\{{))[^`\\$]*+)*+`"
    return text


TEMPLATE = rf"`(?s:.*?){_END}`"  # for one that is not well formed
# a slash begins a regular expression where no value can stand before it
REGEX = (
    r"/(?<=(?:[(,=:\[!&|?{};+*%~^<>-]|\b(?:return|typeof|case|in|of|do|else|void|delete|throw|new|await|yield))[ \t]{0,20}/|^[ \t]{0,200}/)(?![/*])"
    r"[^/\\\[\n]*+(?:(?:\\[^\n]|\[[^\]\\\n]*+(?:\\[^\n][^\]\\\n]*+)*+\])[^/\\\[\n]*+)*+/[a-z]*"
)
TRIPLE = rf'"""(?s:.*?){_END}"""'
TRIPLE_SINGLE = rf"'''(?s:.*?){_END}'''"
SLASHES = r"//[^\n]*"
BLOCK = r"/\*(?s:.*?)\*/"
HASH = r"#[^\n]*"

PARENS = _nested(r"\(", r"\)", "[^()]*+", 12)
#: Type arguments of a Rust call.
TURBOFISH = "::" + _nested("<", ">", "[^<>;{}-]*+(?:->?[^<>;{}-]*+)*+", 6)
ANGLES = r"<[^;(){}]*>"
NOT_A_NAME = (
    "if|else|for|while|switch|case|return|throw|new|do|try|catch|synchronized|using|lock|"
    "foreach|when|typedef|goto|delete|delegate|elif|sizeof|typeof|await|yield"
)

# words that look like a call in front of a parenthesis
NOT_CALLED = [
    "if", "else", "elif", "for", "foreach", "while", "until", "unless", "loop", "switch", "match",
    "case", "when", "guard", "return", "throw", "catch", "except", "try", "do", "fn", "func", "fun",
    "function", "def", "class", "lambda", "new", "delete", "del", "and", "or", "not", "in", "is",
    "as", "with", "yield", "await", "async", "typeof", "sizeof", "using", "lock", "synchronized",
    "import", "from", "use", "where", "pub", "let", "var", "val", "const", "assert", "raise", "mut",
    "array", "list", "isset", "empty", "unset", "echo", "defined", "elsif", "init", "constructor",
]


@dataclass(frozen=True)
class Rules:
    family: str  # how blocks are delimited: brace, indent or end
    mask: list[str]  # literals first, then comments, in order of precedence
    comment: str  # how a comment token begins
    # containers: (kind, regex with the name in group 1 or a fixed name)
    containers: list[tuple[str, str]] = field(default_factory=list)
    # function headers: (regex, name group, receiver group, path of containers)
    functions: list[tuple[str, int, int, str]] = field(default_factory=list)
    # headers that only count inside a class body (or with these rules)
    members: list[tuple[str, int, int, str]] = field(default_factory=list)
    separator: str = "."
    qualify: str = "last"  # last container only, or join all
    container_rows: str = ""  # path where containers are function rows themselves
    annotation: str = ""  # lines that belong to the function below them
    # headers that count only below an annotation, as in C a name below its type
    untyped: list[tuple[str, int, int, str]] = field(default_factory=list)
    spoiler: str = ""  # a header right below such a line is not a function
    quiet: tuple[str, str] | None = None  # opens and closes lines that call nothing
    body_stop: str = "{"  # characters that begin a body, outside parentheses
    member_needs_body: bool = False
    function_needs_body_in: str = ""  # path in which a bodiless header is no function
    expression_body: bool = False  # `fun f() = ...` ends with its line
    arrow: bool = False  # the first member rule is an arrow function: all text is signature
    call_glue: str = r"\."
    call_regex: str = ""  # callee in group 1
    call_strip: tuple[str, str] | None = None  # (text, regex): removed before calls are read
    defines: str = "class"  # keywords whose name is no call
    imports: str = ""  # first line of an import, on the masked line
    import_text: str = "statement"  # statement, or a regex whose group 1 is the text
    import_end: str = ""  # last line of a longer import
    import_block: tuple[str, str, str] | None = None  # opens, closes, entry


_JAVA_MODS = "(?:(?:public|private|protected|static|final|abstract|sealed|non-sealed|strictfp)\\s+)*"
_JAVA_ANNO = r"(?:@[\w.]+(?:\([^()]*\))?\s+)*"
_CS_MODS = (
    "(?:(?:public|private|protected|internal|static|sealed|abstract|partial|readonly|unsafe|file|new|ref)\\s+)*"
)
_CS_ATTR = r"(?:\[[^\]]*\]\s*)*"
_KT_MODS = (
    r"(?:@[\w.]+(?:\([^()]*\))?\s+)*(?:(?:public|private|internal|protected|abstract|open|sealed|data|inner|"
    r"enum|annotation|value|inline|expect|actual|final|override|suspend|operator|infix|tailrec|external|const|"
    r"lateinit|companion)\s+)*"
)
_SWIFT_MODS = (
    r"(?:@[\w.]+(?:\([^()]*\))?\s+)*(?:(?:public|private|fileprivate|internal|open|final|indirect|static|override|"
    r"mutating|nonmutating|convenience|required|class(?=\s+func))\s+)*"
)
_C_WORDS = r"(?:[A-Za-z_]\w*(?:\s+|\s*\*+\s*))"
_CPP_WORDS = rf"(?:[A-Za-z_][\w:]*(?:{ANGLES})?(?:\s+|\s*[*&]+\s*))"
# a type on a line of its own, at the left as the name below it
_TYPE_LINE = (
    r"^(?!(?:else|do|try|public|private|protected|default|return|break|continue|goto)\b)"
    r"(?:(?:struct|union|enum)\s+)?[A-Za-z_][\w:]*(?:\s+[A-Za-z_]\w*)*(?:\s*\*+)?\s*$"
)
_NOT = rf"(?!\s*(?:{NOT_A_NAME})\b)"

_C_MASK = [DOUBLE, CHAR, SLASHES, BLOCK]
_TS = dict(
    family="brace",
    mask=[_templates(3), TEMPLATE, DOUBLE, SINGLE, SLASHES, BLOCK, REGEX],
    comment="//|/\\*",
    containers=[("C", r"^\s*(?:export\s+)?(?:default\s+)?class\s+([\w$]+)")],
    functions=[
        (r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+([\w$]+)", 1, 0, "^$"),
    ],
    members=[
        (
            rf"^\s*(?:export\s+)?(?:const|let)\s+([\w$]+)\s*(?::[^=]+)?=\s*(?:async\s+)?(?:<[^>]*>\s*)?"
            rf"(?:{PARENS}\s*(?::[^=]+?)?|[\w$]+)\s*=>",
            1, 0, "^$",
        ),
        (
            rf"^{_NOT}\s*(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*"
            r"(#?[\w$]+)\s*(?:<[^>(]*>)?\s*\(",
            1, 0, "^C$",
        ),
    ],
    member_needs_body=True,
    arrow=True,
    call_glue=r"\??\.",
    call_regex=r"(\.?(?<![\w$])[A-Za-z_$][\w$]*+(?:\??\.#?[A-Za-z_$][\w$]*+)*+)(?=\s*(?:<[\w\s,.<>\[\]|]*>)?\s*\()",
    defines="function|new|class",
    imports=r"^import\b(?!\s*\()",
    import_end=r"""["'][^"']*["']\s*;?\s*$""",
)

RULES: dict[str, Rules] = {
    "rust": Rules(
        family="brace",
        mask=[r'\bb?r(#*)"(?s:.*?)"\1', DOUBLE_MULTI, CHAR, SLASHES, BLOCK],
        comment="//|/\\*",
        containers=[
            (
                "I",
                r"^\s*(?:unsafe\s+)?impl(?:\s*<[^{]*?>)?\s+(?:[^{]*?\bfor\s+)?([^{]+?)\s*(?:\bwhere\b[^{]*)?"
                r"(?:\{[^{]*)?$",
            )
        ],
        functions=[
            (
                r'^\s*(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|default|extern(?:\s+"")?)\s+)*fn\s+(\w+)',
                1, 0, "^I?$",
            )
        ],
        separator="::",
        call_glue=r"::|\.",
        call_regex=rf"(\.?\b[A-Za-z_]\w*+(?:(?:::|\.)[A-Za-z_]\w*+|{TURBOFISH})*+(?:!(?=\s*[\[{{(]|$)|(?=\s*\()))",
        call_strip=("!", rf"(?<=\w!)\s*{PARENS}"),
        defines="fn",
        imports=r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s",
        import_end=";",
    ),
    "python": Rules(
        family="indent",
        defines=r"def|class",
        mask=[TRIPLE, TRIPLE_SINGLE, DOUBLE, SINGLE, HASH],
        comment="#",
        containers=[("C", r"^\s*class\s+(\w+)")],
        functions=[(r"^\s*(?:async\s+)?def\s+(\w+)", 1, 0, "^C*$")],
        container_rows="^C*$",
        imports=r"^(?:import|from)\s",
        import_end=r"\)",
    ),
    "go": Rules(
        family="brace",
        defines=r"func",
        mask=[r"`(?s:.*?)`", DOUBLE, CHAR, SLASHES, BLOCK],
        comment="//|/\\*",
        functions=[(r"^func\s+(\w+)\s*[(\[]", 1, 0, "^$")],
        members=[(r"^func\s*\(\s*(?:\w+\s+)?\**([\w.]+(?:\[[^\]]*\])?)\s*\)\s*(\w+)", 2, 1, "^$")],
        imports=r"^import\s",
        quiet=(r"\binterface\s*\{\s*$", r"^\s*\}"),
        call_strip=("interface", r"\binterface\s*\{[^{}]*\}"),
        import_text=r'^import\s+(?:[\w.]+\s+)?"([^"]*)"',
        import_block=(r"^import\s*\(", r"^\s*\)", r'^\s*(?:[\w.]+\s+)?"([^"]*)"'),
    ),
    "java": Rules(
        family="brace",
        defines=r"new|class",
        mask=[TRIPLE, DOUBLE, CHAR, SLASHES, BLOCK],
        comment="//|/\\*",
        containers=[("C", rf"^\s*{_JAVA_ANNO}{_JAVA_MODS}class\s+(\w+)")],
        members=[(rf"^\s*{_JAVA_ANNO}{_NOT}[^=;(){{}}@]*?\b(\w+)\s*\(", 1, 0, "^C$")],
        annotation=r"^\s*@[\w.]+(?:\s*\(.*\))?\s*$",
        call_strip=("@", r"@[\w.]+"),
        imports=r"^import\s",
        import_text=r"^import\s+(?:static\s+)?([^;]*?)\s*;",
    ),
    "typescript": Rules(**_TS),
    "javascript": Rules(**_TS),
    "c": Rules(
        family="brace",
        mask=_C_MASK,
        comment="//|/\\*",
        functions=[(rf"^{_NOT}\s*{_C_WORDS}*[A-Za-z_]\w*\s+([A-Za-z_]\w*)\s*\(", 1, 0, "^$")],
        members=[
            (rf"^{_NOT}\s*(?:[A-Za-z_]\w*\s+)*[A-Za-z_]\w*\s*\*\s*(\**\s*[A-Za-z_]\w*\s*\([^)]*\)?)", 1, 0, "^$")
        ],
        untyped=[(rf"^{_NOT}([A-Za-z_]\w*)\s*\(", 1, 0, "^$")],
        annotation=_TYPE_LINE,
        member_needs_body=True,
        call_glue=r"->|\.",
        imports=r"^\s*#\s*include\b",
    ),
    "cpp": Rules(
        family="brace",
        defines=r"new|class|struct",
        mask=[r'\bR"(\w*)\((?s:.*?)\)\1"', *_C_MASK],
        comment="//|/\\*",
        containers=[
            ("N", r"^\s*(?:inline\s+)?namespace\s+(\w+)\s*(?:\{.*)?$"),
            ("E", r'^\s*(?:(?:inline\s+)?namespace\b()|extern\s+""())'),
            ("C", r"^\s*(?:class|struct)\s+(?:[A-Z_]+\s+)?(\w+)\b[^;=()]*$"),
        ],
        functions=[
            (rf"^{_NOT}\s*(?:\[\[[^\]]*\]\]\s*)?{_CPP_WORDS}*[A-Za-z_][\w:]*(?:{ANGLES})?(?:\s+|\s*&+\s*)([~\w:]+)\s*\(",
             1, 0, "^[NEC]*$"),
        ],
        members=[
            (rf"^{_NOT}\s*(?:[\w:]+\s+)*[\w:]+(?:{ANGLES})?\s*\*\s*(\**\s*[~\w:]+\s*\([^)]*\)?)", 1, 0, "^[NEC]*$"),
            (rf"^{_NOT}\s*(?:explicit\s+|virtual\s+|inline\s+)?(~?\w+)\s*\(", 1, 0, "^[NEC]*C$"),
            (rf"^{_NOT}\s*(\w+(?:::~?\w+)+)\s*\(", 1, 0, "^[NE]*$"),
        ],
        untyped=[(rf"^{_NOT}(~?[A-Za-z_][\w:]*)\s*\(", 1, 0, "^[NE]*$")],
        annotation=_TYPE_LINE,
        separator="::",
        qualify="join",
        spoiler=r"^\s*template\s*<[^;{}]*$",
        function_needs_body_in="C$",
        call_glue=r"->|\.|::",
        imports=r"^\s*#\s*include\b",
    ),
    "csharp": Rules(
        family="brace",
        defines=r"new|class",
        mask=[TRIPLE, r'@\$?"(?s:.*?)(?<!")(?:"")*"(?!")', DOUBLE, CHAR, SLASHES, BLOCK],
        comment="//|/\\*",
        containers=[
            ("C", rf"^\s*{_CS_ATTR}{_CS_MODS}(?:class|struct|record(?:\s+(?:class|struct))?)\s+(\w+)"),
            ("N", r"^\s*namespace\s+([\w.]+)\s*(?:\{.*)?$"),
        ],
        members=[(rf"^\s*{_CS_ATTR}{_NOT}[^=;(){{}}~]*?\b(\w+)\s*(?:<[^>(]*>)?\s*\(", 1, 0, "^N*C$")],
        annotation=r"^\s*\[[^\]]*\]\s*$",
        body_stop="{=",
        call_glue=r"\??\.",
        call_strip=("[", r"^\s*\[[^\]]*\]"),
        imports=r"^using\s",
        import_text=r"^using\s+(?:static\s+)?([^;]*?)\s*;",
    ),
    "kotlin": Rules(
        family="brace",
        defines=r"fun|class",
        mask=[TRIPLE, DOUBLE, CHAR, SLASHES, BLOCK],
        comment="//|/\\*",
        containers=[
            ("P", r"^\s*(?:\w+\s+)*(?:(?i:c)ompanion)(?=\s+object)()"),
            ("C", rf"^\s*{_KT_MODS}(?:fun\s+)?(?:class|interface)\s+(\w+)"),
            ("O", rf"^\s*{_KT_MODS}object\s+(\w+)"),
        ],
        functions=[
            (rf"^\s*{_KT_MODS}fun\s+(?:<[^>]*>\s*)?(?:([\w<>?, ]+)\.)?(\w+)\s*\(", 2, 1, "^(?:C|O|CP)?$")
        ],
        members=[(rf"^\s*{_KT_MODS}(constructor)\s*\(", 1, 0, "^(?:C|O|CP)$")],
        qualify="join",
        annotation=r"^\s*@[\w.]+(?:\s*\(.*\))?\s*$",
        body_stop="{=",
        expression_body=True,
        call_glue=r"\??\.",
        call_strip=("@", r"@[\w.]+"),
        imports=r"^import\s",
        import_text=r"^import\s+(.*?)\s*$",
    ),
    "php": Rules(
        family="brace",
        mask=[r"<<<\s*([\"']?)(\w+)\1\n(?s:.*?)\n\s*\2\b", DOUBLE_MULTI, SINGLE_MULTI, SLASHES, BLOCK, r"#(?!\[)[^\n]*"],
        comment="//|/\\*|#",
        containers=[("C", r"^\s*(?:(?:final|abstract|readonly)\s+)*class\s+(\w+)")],
        functions=[
            (r"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?\s*(\w+)\s*\(", 1, 0, "^C?$")
        ],
        annotation=r"^\s*#\[.*\]\s*$",
        call_regex=r"((?:->|::)?(?<![\w$\\])\$?[A-Za-z_\\][\w\\]*+(?:(?:->|\?->|::)\$?[A-Za-z_]\w*+)*+)(?=\s*\()",
        defines="function|new|class",
        imports=r"^use\s",
        import_text=r"^use\s+([^;]*?)\s*;",
    ),
    "ruby": Rules(
        family="end",
        defines=r"def|class",
        mask=[r"(?m:^=begin\b(?s:.*?)^=end\b)", r"<<[~-]([A-Z]\w*)[^\n]*\n(?s:.*?)\n\s*\1\b", DOUBLE_MULTI, SINGLE_MULTI, r"#(?!\{)[^\n]*"],
        comment="#|=begin",
        containers=[("C", r"^\s*class\s+([\w:]+)"), ("M", r"^\s*module\s+([\w:]+)")],
        functions=[(r"^\s*def\s+((?:self\.)?(?:\w+[?!=]?|[^\s\w(]+))", 1, 0, "^C*$")],
        container_rows="^C*$",
        call_regex=(
            r"((?<!\w)(?:@{0,2}[A-Za-z_]\w*+(?:\.|&\.|::))+[A-Za-z_]\w*+[?!]?|\b[A-Za-z_]\w*+[?!]?(?=\()|"
            r"(?<=^|\s)[a-z_]\w*[?!]?(?=\s+[\"':@\w\[]))"
        ),
        imports=r"^require(?:_relative)?\b",
    ),
    "swift": Rules(
        family="brace",
        defines=r"func|class",
        mask=[TRIPLE, DOUBLE, SLASHES, BLOCK],
        comment="//|/\\*",
        containers=[
            ("C", rf"^\s*{_SWIFT_MODS}(?:class|struct|enum|extension|actor)\s+(?!func\b|var\b|let\b)([\w.]+)")
        ],
        functions=[(rf"^\s*{_SWIFT_MODS}func\s+(\w+|[^\s\w(]+)\s*[(<]", 1, 0, "^C?$")],
        members=[(rf"^\s*{_SWIFT_MODS}(init)[?!]?\s*[(<]", 1, 0, "^C$")],
        annotation=r"^\s*@[\w.]+(?:\s*\(.*\))?\s*$",
        call_glue=r"\??\.",
        call_strip=("@", r"@[\w.]+"),
        imports=r"^(?:@\w+\s+)?import\s",
        import_text=r"^(?:import\s+)?(.*?)\s*$",
    ),
}
