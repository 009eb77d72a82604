"""A small converter from LaTeX to MathML: letters, numbers, operators, Greek, scripts, fractions and roots.

What it doesn't know raises :class:`Unsupported`; callers keep such formulas as
text.
"""

from __future__ import annotations

import re

# Commands that stand for one character.
SYMBOLS = {
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ϵ", "zeta": "ζ", "eta": "η", "theta": "θ", "iota": "ι", "kappa": "κ", "lambda": "λ", "mu": "μ",
    "nu": "ν", "xi": "ξ", "pi": "π", "rho": "ρ", "sigma": "σ", "tau": "τ", "upsilon": "υ", "phi": "ϕ", "chi": "χ", "psi": "ψ", "omega": "ω",
    "Gamma": "Γ", "Delta": "Δ", "Theta": "Θ", "Lambda": "Λ", "Xi": "Ξ", "Pi": "Π", "Sigma": "Σ", "Phi": "Φ", "Psi": "Ψ", "Omega": "Ω", "infty": "∞", "partial": "∂",
}
OPERATORS = {
    "times": "×", "cdot": "⋅", "pm": "±", "leq": "≤", "le": "≤", "geq": "≥", "ge": "≥", "neq": "≠", "ne": "≠", "approx": "≈", "to": "→", "rightarrow": "→", "in": "∈",
    "sum": "∑", "prod": "∏", "int": "∫", "ldots": "…", "cdots": "⋯", "nabla": "∇", "forall": "∀", "exists": "∃", "cup": "∪", "cap": "∩", "subset": "⊂", "equiv": "≡", "sim": "∼",
}
SPACES = {",", ";", ":", "!", " ", "quad", "qquad"}
NAMES = {"sin", "cos", "tan", "log", "ln", "exp", "lim", "max", "min", "det"}
NAMESPACE = "http://www.w3.org/1998/Math/MathML"
_TOKEN = re.compile(r"\\(?:[A-Za-z]+|.)|\d+(?:\.\d+)?|[A-Za-z]|[{}^_]|\s+|[^\s\\{}^_]", re.DOTALL)


class Unsupported(ValueError):
    """A formula that this converter can't express."""


def _esc(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


class _Reader:
    def __init__(self, latex: str):
        self.tokens = [t for t in _TOKEN.findall(latex) if not t.isspace()]
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self) -> str:
        if self.at >= len(self.tokens):
            raise Unsupported("formula ends early")
        self.at += 1
        return self.tokens[self.at - 1]

    def row(self, until: str | None = None) -> str:
        out = []
        while self.peek() != until:
            out.append(self.scripted())
        if until:
            self.take()
        return "".join(out)

    def group(self) -> str:
        if self.peek() == "{":
            self.take()
            return f"<mrow>{self.row('}')}</mrow>"
        return self.atom()

    def scripted(self) -> str:
        base, low, high = self.atom(), None, None
        while self.peek() in ("^", "_"):
            mark = self.take()
            if (mark == "^" and high) or (mark == "_" and low):
                raise Unsupported("double script")
            low, high = (low, self.group()) if mark == "^" else (self.group(), high)
        if low and high:
            return f"<msubsup>{base}{low}{high}</msubsup>"
        return f"<msup>{base}{high}</msup>" if high else f"<msub>{base}{low}</msub>" if low else base

    def atom(self) -> str:
        t = self.take()
        if t == "{":
            return f"<mrow>{self.row('}')}</mrow>"
        if t in ("}", "^", "_"):
            raise Unsupported(t)
        if t[0] == "\\":
            return self.command(t[1:])
        if t[0].isdigit():
            return f"<mn>{t}</mn>"
        return f"<mi>{_esc(t)}</mi>" if t.isalpha() else f"<mo>{_esc(t)}</mo>"

    def command(self, name: str) -> str:
        if name == "frac":
            return f"<mfrac>{self.group()}{self.group()}</mfrac>"
        if name == "sqrt":
            if self.peek() == "[":
                self.take()
                index = self.row("]")
                return f"<mroot>{self.group()}<mrow>{index}</mrow></mroot>"
            return f"<msqrt>{self.group()}</msqrt>"
        if name in SYMBOLS:
            return f"<mi>{SYMBOLS[name]}</mi>"
        if name in OPERATORS:
            return f"<mo>{OPERATORS[name]}</mo>"
        if name in NAMES:
            return f"<mi>{name}</mi>"
        if name in SPACES:
            return "<mspace/>"
        if name in ("left", "right"):
            return f"<mo>{_esc(self.take())}</mo>"
        if name in "{}%$&#_":
            return f"<mo>{_esc(name)}</mo>"
        raise Unsupported(name)


def mathml(latex: str, display: bool = False) -> str:
    """MathML markup of a formula."""
    reader = _Reader(latex.strip())
    body = reader.row()
    if not body:
        raise Unsupported("empty formula")
    return f'<math display="{"block" if display else "inline"}" xmlns="{NAMESPACE}"><mrow>{body}</mrow></math>'
