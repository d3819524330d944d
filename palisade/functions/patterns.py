"""Turn the neutral pattern notation into an engine's regular expression.

The notation means what a Unicode-aware matcher means: ``\\d`` any decimal
digit, ``\\w`` any letter, number or underscore, ``\\s`` any white space.  Java
reads those classes as ASCII (and its ``(?U)`` mode adds combining marks to
``\\w``), so the classes are spelled out.  Both Java and RE2 read the result.
"""

from __future__ import annotations

SPACE = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACE_CHARS = "".join(chr(c) for c in (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
WORD = r"\p{L}\p{N}_"
# The same class for Java: two range tests turn away most characters at once.
_JAVA_SPACE = rf"[\x{{00}}-\x{{20}}\x{{85}}-\x{{3000}}&&[{SPACE}]]"
_CLASSES = {"s": SPACE, "w": WORD, "d": r"\p{Nd}"}
_ANY_EDGE = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"


def compile_pattern(pattern: str, *, ignore_case: bool = False, edges: str = "word",
                    atomic_space: bool = False, engine: str = "java") -> str:
    """``pattern`` as a Java regular expression (``engine="re2"``: for a SQL engine on RE2)."""
    out, in_class, negated, i = [], False, False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            code = pattern[i + 1]
            i += 2
            if code in _CLASSES:
                body = _CLASSES[code]
                if code == "s" and engine == "java" and not negated:
                    out.append(_JAVA_SPACE)
                else:
                    out.append(body if in_class else f"[{body}]")
                if code == "s" and not in_class and atomic_space and engine == "java" and pattern[i:i + 1] in ("*", "+"):
                    out.append(pattern[i] + "+")
                    i += 1
            elif code == "b" and engine == "java":
                opening = not out or pattern[i - 3] in "|(:"
                loose = edges in ("any", "open" if opening else "close")
                out.append(_ANY_EDGE if loose else f"(?<![{WORD}])" if opening else f"(?![{WORD}])")
            else:
                out.append("\\" + code)
            continue
        if ch == "[" and not in_class:
            in_class, negated = True, pattern[i + 1:i + 2] == "^"
        elif ch == "]" and in_class:
            in_class = negated = False
        out.append(ch)
        i += 1
    flags = ("(?iu)" if engine == "java" else "(?i)") if ignore_case else ""
    return flags + "".join(out)


def compile_rule(rule, engine: str = "java") -> str:
    return compile_pattern(rule.pattern, ignore_case=rule.ignore_case, edges=rule.edges,
                           atomic_space=rule.atomic_space, engine=engine)


def _branches(body: str) -> list[str]:
    """Split a pattern at its outermost alternation bars."""
    parts, depth, in_class, last, i = [], 0, False, 0, 0
    while i < len(body):
        ch = body[i]
        if ch == "\\":
            i += 1
        elif in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch in "()":
            depth += 1 if ch == "(" else -1
        elif ch == "|" and depth == 0:
            parts.append(body[last:i])
            last = i + 1
        i += 1
    return parts + [body[last:]]


def _group_end(body: str) -> int:
    """Index just past the group that opens ``body``."""
    depth = 0
    for i, ch in enumerate(body):
        depth += (ch == "(") - (ch == ")")
        if depth == 0:
            return i + 1
    return len(body)


def _openers(branch: str) -> str:
    """Letters a branch can begin with; empty when that is not plain to see."""
    if branch[:1].isalpha():
        return branch[0].lower()
    if branch.startswith("(?:") and branch[_group_end(branch):][:1] not in ("?", "*"):
        found = [_openers(b) for b in _branches(branch[3:_group_end(branch) - 1])]
        return "" if "" in found else "".join(found)
    return ""


def gate_pattern(rules) -> str:
    """One pattern that every page with a hit of any of these case-blind rules must match.

    The branches of all rules are sorted by opening letter, so a position in
    the text is tried against the few branches that could start there.
    """
    by_letter: dict[str, list[str]] = {}
    bounded = all(r.pattern.startswith(r"\b") for r in rules)
    for rule in rules:
        body = rule.pattern.removeprefix(r"\b").removesuffix(r"\b")
        if body.startswith("(?:") and _group_end(body) == len(body):
            body = body[3:-1]
        for branch in _branches(body):
            for letter in sorted(set(_openers(branch))) or [""]:
                by_letter.setdefault(letter, []).append(
                    compile_pattern(branch, edges=rule.edges, atomic_space=rule.atomic_space))
    tests = [(f"(?=[{_spellings(k)}])" if k else "") + f"(?iu:{'|'.join(v)})" for k, v in sorted(by_letter.items())]
    start = "" if "" in by_letter else f"(?=[{''.join(_spellings(k) for k in sorted(by_letter))}])"
    return start + (f"(?<![{WORD}])" if bounded else "") + f"(?:{'|'.join(tests)})"


def _spellings(letter: str) -> str:
    """A letter in both cases, with the two characters that fold to an ASCII letter."""
    return letter + letter.upper() + {"k": r"\x{212A}", "s": r"\x{17F}"}.get(letter, "")


def literal_pattern(text: str) -> str:
    """A case-blind literal search that agrees with ``lower(text) contains lower(literal)``.

    Lowering whole pages is the costly way to do this; a class per character is not.
    """
    parts = []
    for ch in text.lower():
        same = {ch, ch.upper()} if len(ch.upper()) == 1 and ch.upper().lower() == ch else {ch}
        same |= {"k": {"\u212a"}, "\u00e5": {"\u212b"}, "\u03c9": {"\u2126"}}.get(ch, set())
        parts.append("[" + "".join(f"\\x{{{ord(c):X}}}" for c in sorted(same)) + "]")
    return "".join(parts)
