"""The words of a LaTeX article's printed running text, sentence by sentence.

One left-to-right scan: comments, unprinted blocks, displayed and inline formulas, references, headings, floats' captions,
footnotes and the bibliography are left out, macros defined in the text itself are expanded (with their arguments, so that
what a macro drops isn't printed), and only what lies between
``\\begin{document}`` and ``\\end{document}`` counts where these are given. Parts that a text includes from elsewhere are
not in it. A block that a broken-off text never closes reaches to its end.
"""

from __future__ import annotations

import re
import unicodedata

#: Stands between sentences.
END = "\x00"

_ARG = r"\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}"
_SKIPPED = (
    "comment|verbatim|lstlisting|equation|align|gather|multline|eqnarray|displaymath|math|tabular|array|matrix|thebibliography|filecontents"
)
_DROPPED = (
    "documentclass|usepackage|RequirePackage|title|author|date|thanks|input|include|subfile|includeonly|includegraphics|bibliography|bibliographystyle"
    "|nocite|label|ref|eqref|autoref|cref|pageref|cite[a-z]*|footnote|footnotetext|url|hspace|vspace|setlength|pagestyle|thispagestyle|newtheorem|theoremstyle|hypersetup|setcounter"
)
_HEADINGS = "part|chapter|section|subsection|subsubsection|paragraph|subparagraph|caption"
_SCAN = re.compile(
    rf"""
    %[^\r\n]*
  | \$\$.*?(?:\$\$|\Z)
  | \$(?:[^$\\\n]|\\.|\n(?![ \t\r]*\n))*\$?
  | \\begin\s*\{{(?P<skip>(?:{_SKIPPED})\*?)\}}.*?(?:\\end\s*\{{(?P=skip)\}}|\Z)
  | \\iffalse(?![a-zA-Z]).*?(?:\\fi(?![a-zA-Z])|\Z)
  | \\\[.*?(?:\\\]|\Z)
  | \\\(.*?(?:\\\)|\Z)
  | \\(?:(?:provide|re|)newcommand|providecommand|DeclareRobustCommand)\*?\s*\{{?\s*\\(?P<new>[a-zA-Z]+)\s*\}}?(?P<args>(?:\[[^\]]*\])*)\s*(?P<body>{_ARG})
  | \\[gex]?def\s*\\(?P<def>[a-zA-Z]+)(?P<defargs>[^{{}}\r\n]*)(?P<defbody>{_ARG})
  | \\(?P<edge>begin|end)\s*\{{(?P<env>[^{{}}]*)\}}(?:\[[^\]]*\])?
  | \\(?:{_HEADINGS})\*?(?:\[[^\]]*\])?(?P<heading>{_ARG})
  | \\(?:{_DROPPED})\*?(?:\s*\[[^\]]*\])*\s*(?P<dropped>{_ARG})
  | \\(?P<name>[a-zA-Z]+)\*?
  | \\(?P<escaped>.)
  | \n[ \t\r]*\n\s*
  | [~{{}}]
    """,
    re.VERBOSE | re.DOTALL,
)
_ODD = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")
_WORD = re.compile(r"[^\W\d_]+(?:['\u2019-][^\W\d_]+)*|[.!?](?=[\s\x00)\"'\u2019]|\Z)|\x00")
_ENDS = frozenset(".!?" + END)
#: Text that macros may add, expansions within each other, and such of the same macro; beyond these a macro stands for
#: nothing, so that a text can't grow without end.
_EXPANDED, _DEPTH, _SAME = 10_000_000, 200, 8
_OPTION = re.compile(r"\s*\[([^\]]*)\]")
_COUNT = re.compile(r"\[(\d)\](?:\[([^\]]*)\])?")
_TOKEN = re.compile(r"\s*(\\[a-zA-Z]+|\\.|[^\s{}])", re.DOTALL)
_PARAMETER = re.compile(r"#([1-9])")


class _Over(Exception):
    """The end of the document."""


def _group(source: str, at: int) -> tuple[str, int]:
    """The argument that begins at a place: a group in braces, or a token; empty at the end. And the place after it."""
    start = at
    while start < len(source) and source[start].isspace():
        start += 1
    if start < len(source) and source[start] == "{":
        depth, i = 0, start
        while i < len(source):
            c = source[i]
            if c == "\\":
                i += 1
            elif c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
                if not depth:
                    return source[start + 1 : i], i + 1
            i += 1
        return source[start + 1 :], len(source)
    token = _TOKEN.match(source, at)
    return (token[1], token.end()) if token else ("", at)


def printed(text: str) -> str:
    """The printed running text; END at the borders of paragraphs, headings, items and blocks."""
    macros: dict[str, tuple[int, str | None, str]] = {}  # number of arguments, value of the first if it is optional, body
    out: list[str] = []
    room = _EXPANDED

    def expand(name: str, source: str, at: int) -> tuple[str, int]:
        """The body of a macro with its arguments, which are read from a place on, and the place after them."""
        n, option, body = macros[name]
        values: list[str] = []
        if option is not None:
            given = _OPTION.match(source, at)
            values.append(given[1] if given else option)
            at = given.end() if given else at
        while len(values) < n:
            value, at = _group(source, at)
            values.append(value)
        return _PARAMETER.sub(lambda p: values[int(p[1]) - 1] if int(p[1]) <= n else "", body) if n else body, at

    def scan(source: str, active: tuple[str, ...]) -> None:
        nonlocal room
        at = 0
        while m := _SCAN.search(source, at):
            if m.start() > at:
                out.append(source[at : m.start()])
            at = m.end()
            kind = m.lastgroup
            if kind is None:
                c = source[m.start()]
                if c == "~":
                    out.append(" ")
                elif c == "\n":
                    out.append(END)
                elif c == "$":
                    out.append(" ")
                elif c == "\\" and source.startswith("\\[", m.start()):
                    out.append(" ")
            elif kind == "name":
                name = m["name"]
                if name in macros:
                    # a star after the name is text unless the macro takes it
                    body, at = expand(name, source, at)
                    room -= len(body)
                    if room >= 0 and len(active) < _DEPTH and active.count(name) < _SAME:
                        scan(body, (*active, name))
                elif name == "item" or name == "par":
                    out.append(END)
            elif kind == "escaped":
                c = m["escaped"]
                if c in "%&#_$":
                    out.append(c)
                elif c in " ,;:!\\/\r\n":
                    out.append(" ")
            elif kind == "body":
                new, count = m["new"], _COUNT.match(m["args"])
                if new not in macros or "providecommand" not in m[0][:15]:
                    macros[new] = (int(count[1]), count[2], m["body"][1:-1]) if count else (0, None, m["body"][1:-1])
            elif kind == "defbody":
                arguments = m["defargs"].strip()
                if re.fullmatch(r"(?:#[1-9])*", arguments):  # arguments set off by other text are not known here
                    macros[m["def"]] = (len(arguments) // 2, None, m["defbody"][1:-1])
            elif kind == "env":
                if m["env"] == "document":
                    if m["edge"] == "end":
                        raise _Over
                    out.clear()
                out.append(END)
            elif kind == "heading" or kind == "skip":
                out.append(END if kind == "heading" else " ")
        out.append(source[at:])

    try:
        scan(text, ())
    except _Over:
        pass
    return "".join(out)


def words(text: str) -> list[str]:
    """Lower-case words of the printed text in order, with END after each sentence."""
    plain = printed(text)
    if not plain.isascii():
        plain = unicodedata.normalize("NFKC", _ODD.sub("", plain))
    return [END if w in _ENDS else w for w in _WORD.findall(plain.lower())]
