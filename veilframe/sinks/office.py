"""Office packages written back with their text replaced and what tells of people around it taken out.

A package is a zip of members. Paragraphs are edited in place in the markup; members that are not touched keep their
bytes. Then comes hygiene: comments, people, custom properties, previews and thumbnails go, names and dates of authors
are emptied, known values in attributes are replaced. Tracked changes and text that no paragraph holds in a hwpx body
are reasons to block: they cannot be cleaned without losing content.
"""

from __future__ import annotations

import io
import re
import zipfile
from dataclasses import dataclass, field

from veilframe.sources import xmltext

# Members that go, members whose author fields are emptied, and the fields.
DROP = ("word/comments", "word/commentsExtended", "word/commentsIds", "word/people", "docProps/custom", "docProps/thumbnail", "xl/comments", "xl/threadedComments", "xl/persons", "ppt/comments", "ppt/commentAuthors", "Preview/", "DocHistory/")
AUTHORS = "creator lastModifiedBy lastSaveBy Manager Company Template lastPrinted keywords description subject"
#: Attributes that may hold a known value.
NAMED_ATTRIBUTES = "name title descr alt tooltip display author"
#: Names that must stay valid identifiers.
IDENTIFIERS = "sheet definedName bookmarkStart hyperlink"
TEXT_MEMBERS = re.compile(r"^(?:word/(?:document|header\d*|footer\d*|footnotes|endnotes|glossary/document)|ppt/(?:slides|notesSlides|slideMasters|slideLayouts)/[^/]+|xl/(?:sharedStrings|worksheets/[^/]+|drawings/[^/]+)|Contents/(?:section|masterpage)\d+)\.xml$")


@dataclass
class Written:
    content: bytes
    blocks: list[str] = field(default_factory=list)
    refused: int = 0


def identifier(name: str) -> str:
    """A pseudonym as an identifier: letters, digits and underscores; never empty."""
    return re.sub(r"[^0-9A-Za-z가-힣_]", "", name) or "가명"


def _numbers(xml: str, edit) -> str:
    """Numeric cells whose value is replaced become text cells."""

    def one(m: re.Match) -> str:
        spans = edit(m["v"])
        if not spans:
            return m[0]
        text = m["v"]
        for a, b, new, *_ in sorted(spans, reverse=True):
            text = text[:a] + new + text[b:]
        attrs = re.sub(r"\st=\"[^\"]*\"", "", m["attrs"])
        if m["f"]:
            return f'<c{attrs} t="str">{m["f"]}<v>{xmltext.escape(text)}</v></c>'
        return f'<c{attrs} t="inlineStr"><is><t>{xmltext.escape(text)}</t></is></c>'

    return re.sub(r"<c(?P<attrs>(?:\s[^<>]*?)?)>(?P<f><f[^>]*>[^<]*</f>|<f[^>]*/>)?<v>(?P<v>[^<]*)</v></c>", lambda m: m[0] if ' t="s"' in m["attrs"] else one(m), xml)


def _attributes(xml: str, values: list[tuple[str, str]]) -> str:
    changes = []
    for name, value, a, b in xmltext.attribute_values(xml):
        if name in NAMED_ATTRIBUTES.split():
            new = value
            for original, pseudonym in values:
                new = new.replace(original, pseudonym)
            if new != value:
                changes.append((a, b, xmltext.escape(new).replace('"', "&quot;")))
    return xmltext.patched(xml, changes)


def _authors(xml: str) -> str:
    for name in AUTHORS.split():
        xml = re.sub(rf"(<(?:[\w]+:)?{name}(?:\s[^<>]*)?>)[^<]*(</)", r"\1\2", xml)
    return xml


def rewrite(content: bytes, edit, values: list[tuple[str, str]] = ()) -> Written:
    """The package with ``edit(member, text)`` - spans (start, end, replacement) of a paragraph's text - carried out.

    ``values`` (original, pseudonym) are known values, the longest first, for attributes and properties.
    """
    out = Written(b"")
    values = sorted(values, key=lambda x: (-len(x[0]), x[0]))
    sink = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as w:
        infos = sorted(z.infolist(), key=lambda i: i.filename != "mimetype")  # hwpx wants its type first, stored
        for info in infos:
            name, data = info.filename, z.read(info)
            if name.startswith(DROP):
                continue
            if name.endswith((".xml", ".rels", ".hpf")):
                xml = new = data.decode("utf-8-sig")
                if TEXT_MEMBERS.match(name):
                    if name.startswith("word/") and re.search(r"<w:(?:ins|del|moveFrom|moveTo)\s", xml):
                        out.blocks.append("tracked changes")
                    changes = []
                    for p in xmltext.paragraphs(xml):
                        if p.text.strip():
                            more, refused = xmltext.edits(p, edit(name, p.text))
                            changes += more
                            out.refused += len(refused)
                    new = xmltext.patched(xml, changes)
                    if name.startswith("xl/worksheets/"):
                        new = _numbers(new, lambda t, name=name: edit(name, t))
                    if name.startswith("Contents/section"):
                        new = re.sub(r"<hp:linesegarray>.*?</hp:linesegarray>|<hp:linesegarray/>", "", new, flags=re.S)
                elif name.startswith("docProps/") or name.endswith((".hpf", "content.hpf")):
                    new = _authors(xml)
                elif name.endswith("[Content_Types].xml") or name.endswith(".rels"):
                    new = re.sub(r"<(?:Override|Relationship)\s[^<>]*?(?:PartName|Target)=\"/?[^\"]*(?:comments|commentAuthors|people|persons|threadedComments|thumbnail|custom)[^\"]*\"[^<>]*/>", "", xml)
                new = _attributes(new, values) if not name.endswith(".rels") else new
                if new != xml:
                    data = new.encode("utf-8")
            fresh = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            fresh.compress_type = zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED
            w.writestr(fresh, data)
    out.content = sink.getvalue()
    if out.refused:
        out.blocks.append("text across a hard border")
    return out
