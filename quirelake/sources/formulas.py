"""Office mathematics (OMML) as LaTeX."""

from __future__ import annotations

from xml.etree import ElementTree as ET

_M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
#: Signs and Greek letters with a name in LaTeX.
SIGNS = dict(zip("αβγδεζηθλμνξπρστφχψω", "alpha beta gamma delta epsilon zeta eta theta lambda mu nu xi pi rho sigma tau phi chi psi omega".split(), strict=True)) | dict(
    zip("ΓΔΘΛΞΠΣΦΨΩ∞≤≥≠≈±×÷·∈∉⊂⊆∪∩→⇒⇔∀∃∂∇∠⊥∥", "Gamma Delta Theta Lambda Xi Pi Sigma Phi Psi Omega infty leq geq neq approx pm times div cdot in notin subset subseteq cup cap to Rightarrow Leftrightarrow forall exists partial nabla angle perp parallel".split(), strict=True)
)
LARGE = {"∑": "\\sum", "∏": "\\prod", "∫": "\\int", "∬": "\\iint", "∮": "\\oint", "⋃": "\\bigcup", "⋂": "\\bigcap"}
ACCENTS = {"̂": "\\hat", "̃": "\\tilde", "̄": "\\bar", "⃗": "\\vec", "̇": "\\dot", "̈": "\\ddot"}


def _plain(text: str) -> str:
    return "".join("\\" + SIGNS[c] + " " if c in SIGNS else c for c in text)


def linear_text(e: ET.Element) -> str:
    """The characters of a formula in a row."""
    return "".join(t.text or "" for t in e.iter(_M + "t"))


def _prop(e: ET.Element, group: str, name: str, default: str) -> str:
    node = e.find(f"{_M}{group}/{_M}{name}")
    return default if node is None else node.get(_M + "val", default)


def to_latex(e: ET.Element | None) -> str:
    """LaTeX of a formula or a part of one; what isn't known is the LaTeX of what it holds."""
    if e is None:
        return ""
    kind = e.tag.removeprefix(_M)
    part = lambda name: to_latex(e.find(_M + name)).strip()
    inner = lambda: "".join(map(to_latex, e))
    if kind == "t":
        return _plain(e.text or "")
    if kind in ("rPr", "ctrlPr", "fPr", "radPr", "naryPr", "dPr", "accPr", "mPr", "sSupPr", "sSubPr", "sSubSupPr", "funcPr", "barPr", "limLowPr", "limUppPr", "eqArrPr"):
        return ""
    if kind == "f":
        return f"\\frac{{{part('num')}}}{{{part('den')}}}"
    if kind in ("sSup", "sSub", "sSubSup"):
        low = f"_{{{part('sub')}}}" if kind != "sSup" else ""
        high = f"^{{{part('sup')}}}" if kind != "sSub" else ""
        return f"{part('e')}{low}{high}"
    if kind == "sPre":
        return f"{{}}_{{{part('sub')}}}^{{{part('sup')}}}{part('e')}"
    if kind == "rad":
        degree = part("deg")
        return f"\\sqrt[{degree}]{{{part('e')}}}" if degree else f"\\sqrt{{{part('e')}}}"
    if kind == "nary":
        sign = _prop(e, "naryPr", "chr", "∫")
        low, high = part("sub"), part("sup")
        return LARGE.get(sign, _plain(sign)) + (f"_{{{low}}}" if low else "") + (f"^{{{high}}}" if high else "") + f" {part('e')}"
    if kind == "acc":
        return f"{ACCENTS.get(_prop(e, 'accPr', 'chr', chr(0x302)), chr(92) + 'hat')}{{{part('e')}}}"
    if kind == "bar":
        return f"\\overline{{{part('e')}}}" if _prop(e, "barPr", "pos", "top") == "top" else f"\\underline{{{part('e')}}}"
    if kind == "d":
        left, right = _prop(e, "dPr", "begChr", "("), _prop(e, "dPr", "endChr", ")")
        between = _prop(e, "dPr", "sepChr", "|").join(to_latex(x).strip() for x in e.findall(_M + "e"))
        escape = lambda c: "." if not c else "\\" + c if c in "{}" else c
        return f"\\left{escape(left)} {between} \\right{escape(right)}"
    if kind == "func":
        name = part("fName")
        return (f"\\{name} " if name.isalpha() and len(name) < 7 else name) + part("e")
    if kind == "limLow":
        return f"{part('e')}_{{{part('lim')}}}"
    if kind == "limUpp":
        return f"{part('e')}^{{{part('lim')}}}"
    if kind == "m":
        rows = " \\\\ ".join(" & ".join(to_latex(c).strip() for c in r.findall(_M + "e")) for r in e.findall(_M + "mr"))
        return f"\\begin{{matrix}} {rows} \\end{{matrix}}"
    if kind == "eqArr":
        return "\\begin{aligned} " + " \\\\ ".join(to_latex(x).strip() for x in e.findall(_M + "e")) + " \\end{aligned}"
    return inner()
