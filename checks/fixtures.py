"""Input tables made from the driver's tables, as SQL text that both engines read.

Source files are text templates over ``part``; the definitions each template
holds are listed next to it by hand, so the right answers are known without a
parser.  ``<K>`` is the row's number, ``<N>``, ``<M>`` and ``<D>`` residues of it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

MARKS = {
    "K": "cast(p_partkey as string)",
    "N": "cast(p_partkey % 97 as string)",
    "M": "cast(p_partkey % 61 as string)",
    "D": "cast(p_partkey % 7 as string)",
    "G": "cast(p_partkey % 97 as string)",
}
CONTROL = {"\n": "chr(10)", "\r": "chr(13)", "\\": "chr(92)"}


def sql_text(template: str) -> str:
    """SQL expression for a text with marks; control characters become ``chr`` calls."""
    parts = []
    for mark, control, literal in re.findall(r"<([A-Z])>|([\n\r\\])|((?:(?!<[A-Z]>)[^\n\r\\])+)", template):
        if mark:
            parts.append(MARKS[mark])
        elif control:
            parts.append(CONTROL[control])
        else:
            parts.append("'" + literal.replace("'", "''") + "'")
    return f"concat({', '.join(parts)})" if parts else "''"


@dataclass
class Unit:
    kind: str
    name: str
    line: int
    code: str
    methods: list[tuple[str, int, str]] = field(default_factory=list)


@dataclass
class Variant:
    content: str
    units: list[Unit]


VARIANTS = [
    Variant(
        "def f_<N>(x):\n    return x + <K>\n",
        [Unit("function", "f_<N>", 1, "def f_<N>(x):\n    return x + <K>")],
    ),
    Variant(
        "import functools\n\n@functools.cache\nasync def f_<N>(x):\n    return <K>\n",
        [Unit("function", "f_<N>", 4, "async def f_<N>(x):\n    return <K>")],
    ),
    Variant(
        "def f_<N>(x):\n    return 0\n\ndef f_<N>(y):\n    return <K>\n",
        [
            Unit("function", "f_<N>", 1, "def f_<N>(x):\n    return 0"),
            Unit("function", "f_<N>", 4, "def f_<N>(y):\n    return <K>"),
        ],
    ),
    Variant(
        "class C_<M>(object):\n    def m(self):\n        return 1\n\n    @property\n"
        "    def m(self):\n        return <K>\n\n    def n(self):\n        return self.m\n",
        [
            Unit(
                "class",
                "C_<M>",
                1,
                "class C_<M>(object):\n    def m(self):\n        return 1\n\n    @property\n"
                "    def m(self):\n        return <K>\n\n    def n(self):\n        return self.m",
                [
                    ("m", 2, "def m(self):\n        return 1"),
                    ("m", 6, "def m(self):\n        return <K>"),
                    ("n", 9, "def n(self):\n        return self.m"),
                ],
            )
        ],
    ),
    Variant(
        "class C_<M>:\n    def m(self):\n        return 1\n\nclass C_<M>:\n    size = <K>\n",
        [
            Unit(
                "class",
                "C_<M>",
                1,
                "class C_<M>:\n    def m(self):\n        return 1",
                [("m", 2, "def m(self):\n        return 1")],
            ),
            Unit("class", "C_<M>", 5, "class C_<M>:\n    size = <K>"),
        ],
    ),
    Variant("def good(x):\n    return x\n\ndef (\n", []),
    Variant(
        "if True:\n    def hidden_<K>():\n        pass\n\ndef f_<N>(x):\n    def inner(y):\n"
        "        return y\n    return inner(x + <K>)\n\nclass C_<M>:\n    class Inner:\n"
        "        def q(self):\n            return 0\n\n    def o(self):\n        return <K>\n",
        [
            Unit(
                "function",
                "f_<N>",
                5,
                "def f_<N>(x):\n    def inner(y):\n        return y\n    return inner(x + <K>)",
            ),
            Unit(
                "class",
                "C_<M>",
                10,
                "class C_<M>:\n    class Inner:\n        def q(self):\n            return 0\n\n"
                "    def o(self):\n        return <K>",
                [("o", 15, "def o(self):\n        return <K>")],
            ),
        ],
    ),
    Variant(
        "def f_<N>(x):\r\n    # <K>\r\n    return x\r\n",
        [Unit("function", "f_<N>", 1, "def f_<N>(x):\n    # <K>\n    return x")],
    ),
    Variant(
        "def f_<N>():\n    return r'{{DOCS}} $1 \\ <K> é'\n",
        [Unit("function", "f_<N>", 1, "def f_<N>():\n    return r'{{DOCS}} $1 \\ <K> é'")],
    ),
    Variant(
        "class C_<M>:\n    size = <K>\n\ndef f_<N>(x):\n    return x * <K>\n",
        [
            Unit("class", "C_<M>", 1, "class C_<M>:\n    size = <K>"),
            Unit("function", "f_<N>", 4, "def f_<N>(x):\n    return x * <K>"),
        ],
    ),
]

PATH = "concat('/repo/p', cast(p_partkey % 7 as string), '/m', lpad(cast(p_partkey as string), 9, '0'), '.py')"


def pick(column: str, choices: list[str]) -> str:
    """``case`` expression that takes choice ``column % n``."""
    cases = " ".join(f"when {i} then {choice}" for i, choice in enumerate(choices))
    return f"case {column} % {len(choices)} {cases} end"


CONTENT = pick("p_partkey", [sql_text(v.content) for v in VARIANTS])

# Paths of the suffix test: some end in the source suffix, most only look like it.
SCAN_PATH = pick(
    "p_partkey",
    [
        PATH,
        sql_text("/repo/p<D>/m<K>.PY"),
        sql_text("/repo/p<D>/m<K>.pyi"),
        sql_text("/repo/p<D>/m<K>.py.bak"),
        sql_text("/repo/p<D>/<K>/.py"),
        sql_text("/repo/p<D>/_<K>.py"),
        sql_text("/repo/.hid/m<K>.txt"),
    ],
)

# Listing with environments: (condition, path).
LISTING = [
    ("true", "/tree/g<G>/p<K>/m.py"),
    ("true", "/tree/g<G>/p<K>/lib/x/n.py"),
    ("p_partkey % 3 = 0", "/tree/g<G>/p<K>/pyvenv.cfg"),
    ("p_partkey % 2 = 0", "/tree/g<G>/p<K>/bin/python"),
    ("p_partkey % 5 = 0", "/tree/g<G>/p<K>/Scripts/python.exe"),
    ("p_partkey % 7 = 0", "/tree/g<G>/p<K>/lib/pyvenv.cfg"),
    ("p_partkey % 7 = 0", "/tree/g<G>/p<K>/lib/bin/python"),
    ("p_partkey % 11 = 0", "/tree/g<G>/q<K>/bin/python"),
]

# Contents for that listing, one function each, and the files whose bytes are broken.
TREE_NAME = "concat('f', replace(replace(path, '/', '_'), '.', '_'))"
TREE_CONTENT = f"concat('def ', {TREE_NAME}, '():', chr(13), chr(10), '    return 1', chr(13), chr(10))"
TREE_BROKEN = "path like '%3/m.py'"

# Sources for the score: ``n`` is p_size, the number of repeated lines.
MEASURED_CONTENT = pick(
    "p_partkey",
    [
        "concat("
        + sql_text("def g_<K>(x, y):\n    # note <K>\n")
        + ", repeat("
        + sql_text("    if x > 1 and y < x + 1:\n        y = y * x\n")
        + ", p_size), "
        + sql_text("    return y\n")
        + ")",
        sql_text("def h_<K>(x):\n    return x\n"),
        "concat("
        + sql_text('class D_<K>:\n    """Doc\n    of <K>."""\n\n    def run(self, x):\n')
        + ", repeat("
        + sql_text("        x = x + self.a - 2\n")
        + ", p_size), "
        + sql_text("        return x\n\n    def stop(self):\n        return 0\n")
        + ")",
        sql_text("class E_<K>:\n    def e(self):\n        return 0\n"),
    ],
)

# The same sources under names that meet across files.
SMELL_CONTENT = MEASURED_CONTENT
for _mine, _shared in (
    ("def g_<K>(x, y):\n", "def s_<N>(x, y):\n"),
    ("def h_<K>(x):\n", "def s_<N>(x):\n"),
    ("class D_<K>:\n", "class S_<M>:\n"),
    ("class E_<K>:\n    def e(self):\n", "class S_<M>:\n    def run(self):\n"),
):
    SMELL_CONTENT = SMELL_CONTENT.replace(sql_text(_mine)[7:-1], sql_text(_shared)[7:-1])

# Model answers over ``conversations``.
FENCE = "repeat(chr(96), 3)"
ANSWER_CASES = [
    "text",
    f"concat('Sure: ', {FENCE}, 'python', chr(10), chr(10), '    x = 1', chr(10), text, chr(10), {FENCE}, ' done')",
    f"concat({FENCE}, 'c++', chr(10), text, {FENCE}, chr(10), 'and', chr(10), {FENCE}, chr(10), 'y = 2', chr(10), {FENCE})",
    f"concat(text, {FENCE}, 'python', chr(10), text)",
    "case when conv_id % 2 = 0 then '' end",
    f"case when conv_id % 2 = 1 then concat({FENCE}, 'py', chr(10), {FENCE}) "
    f"else concat({FENCE}, 'python title=x', chr(10), 'lost', {FENCE}, chr(10), text, {FENCE}) end",
]
ANSWER = pick("(conv_id + turn)", ANSWER_CASES)
ANSWER_BLOCK = pick(
    "(conv_id + turn)",
    [
        "''",
        "concat('    x = 1', chr(10), text, chr(10))",
        "concat(text, chr(10), chr(10), 'y = 2', chr(10))",
        "''",
        "''",
        "case when conv_id % 2 = 1 then '' else text end",
    ],
)
ANSWER_NAME = "concat('c', cast(conv_id as string), '.t', cast(turn as string))"

# Markdown over ``documents``: whole texts with an image, links and a run of newlines.
MARKDOWN = (
    "concat('![b', cast(doc_id as string), '](i.png)', repeat(chr(10), 4), text, "
    "' [ref](https://x.y/', cast(doc_id as string), ') [rel](./a.md) ', source)"
)
CLEAN_MARKDOWN = (
    "concat(chr(10), chr(10), {text}, '  [rel](./a.md) ', source)"
)

# Prompt catalogue over ``benchmark``; every fifth template lacks the code token.
CATALOGUE = {
    "prompt_id": "concat('item_', cast(item_id as string))",
    "temperature": "concat('0.', cast(item_id % 10 as string))",
    "description": "concat('about ', cast(item_id as string))",
    "template": "concat(text, chr(10), case when item_id % 5 = 0 then '' else '{{CODE}}' end, "
    "chr(10), '{{DOCS}} / {{DOCS}}')",
}

# URLs over ``pages`` with the forms that need care.
BARE_URL = "regexp_replace(url, '[?#].*$', '')"
URL = pick(
    "page_id",
    [
        "url",
        "replace(url, 'http', 'HTTP')",
        f"concat({BARE_URL}, '/a.b/./c.tar.gz/?q=1#f')",
        f"concat({BARE_URL}, ';v=1?x=2')",
        "concat('git@host:team/repo-', cast(page_id as string), '.git')",
        "concat('  ', url)",
        f"concat({BARE_URL}, '/x[1].')",
    ],
)
