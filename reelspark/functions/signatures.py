"""What the first bytes of a file say about its container, and what its extension suggests, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CERTAIN, PROBABLE, WEAK = 2, 1, 0
RAW = "RawElementaryStream"

# Fixed values of F39: signatures at offset 0 and their containers, in order; those of four bytes or more are certain.
SIGNATURES = (
    (b"\x1a\x45\xdf\xa3", "Matroska"),
    (b"OggS", "Ogg"),
    (b"FLV\x01", "Flv"),
    (b"\x30\x26\xb2\x75\x8e\x66\xcf\x11", "Asf"),
    (b"\x00\x00\x01\xba", "MpegPs"),
    (b"\x00\x00\x01\xb3", RAW),
    (b"\x00\x00\x00\x01", RAW),
    (b"\x00\x00\x01", RAW),
    (b"\x1fVP8", "WebM"),
    (b"DKIF", "WebM"),
    (b"\xff\xd8\xff", RAW),
    (b"ID3", RAW),
    (b"fLaC", RAW),
    (b"\x0bwvpK", RAW),
    (b"MAC ", RAW),
    (b"DSD ", RAW),
    (b"FRM8", RAW),
)
# Fixed values of F39: boxes that a file may begin with, brands of fragmented files, sizes of transport packets.
BOXES = ("ftyp", "styp", "moov", "mdat", "free", "skip", "wide", "pnot", "moof")
FRAGMENTED = ("dash", "cmfc", "cmf2", "msdh", "msix", "iso5", "iso6")
PACKETS = (188, 192, 204)
# Fixed values of O7: what extensions suggest.
SUGGESTED = {
    "Matroska": "mkv mka mks mk3d", "WebM": "webm", "Mp4": "mp4 m4v m4a m4b m4r mp4v mov qt 3gp 3g2", "FragmentedMp4": "m4s cmfv cmfa", "MpegTs": "ts m2ts mts m2t tp tsv",
    "MpegPs": "mpg mpeg vob evo mod tod", "Avi": "avi divx", "Asf": "wmv wma asf", "Flv": "flv f4v", "Ogg": "ogg ogv oga opus spx ogm", "DiscStructure": "iso",
}
# Fixed values of P2: what unambiguous extensions promise.
PROMISED = {"Matroska": "mkv", "WebM": "webm", "Mp4": "mp4 m4v mov", "Avi": "avi", "Asf": "wmv asf", "Flv": "flv", "Ogg": "ogv"}


def _bytes(value: bytes) -> Column:
    return F.lit(bytearray(value))


def _part(head: Column, start: int, size: int = 4) -> Column:
    return F.substring(head, start + 1, size)


def _found(when: Column, container: str | Column, confidence: int | Column) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(when, F.struct(as_column(container).alias("container"), as_column(confidence).cast("int").alias("confidence")))


def candidates(head: Column) -> Column:
    """array of (container, confidence), the surest first, equally sure ones in the order of the rules; each container once, by its first rule.

    head: the first bytes (4096 are enough). Always ends with a guess of confidence 0, unless the same container was found by a rule; a null
    head is as an empty one. A box needs 12 bytes. Four packets with the sync byte at one distance make a transport stream, certain if the
    first byte is one. A file of this kind is WebM and not Matroska if its header (64 bytes are looked at) names that type.
    """
    head = F.coalesce(head, _bytes(b""))
    enough, box, brand = F.octet_length(head) >= 12, _part(head, 4), _part(head, 8)
    is_box = enough & box.isin(*(bytearray(b.encode()) for b in BOXES))
    typed = box.isin(bytearray(b"ftyp"), bytearray(b"styp"))
    one_of = lambda c: c.isin(*(bytearray(b.encode()) for b in FRAGMENTED))
    parts = one_of(brand) | (box == _bytes(b"styp"))
    for i in range(8):
        parts = parts | one_of(_part(head, 16 + 4 * i))
    fragmented = typed & (brand != _bytes(b"qt  ")) & parts
    rules = [_found(is_box, F.when(fragmented, "FragmentedMp4").otherwise("Mp4"), F.when(typed, CERTAIN).otherwise(PROBABLE))]
    latin = F.decode(head, "ISO-8859-1")
    rules.append(_found(F.startswith(head, _bytes(SIGNATURES[0][0])) & F.left(latin, F.lit(64)).contains("\x42\x82\x84webm"), "WebM", CERTAIN))
    rules += [_found(F.startswith(head, _bytes(s)), container, CERTAIN if len(s) >= 4 else PROBABLE) for s, container in SIGNATURES]
    sure = None
    for size in PACKETS:
        packets = f"G(?:.{{{size - 1}}}G){{3}}"
        at_start, later = latin.rlike(f"(?s)^{packets}"), latin.rlike(f"(?s)^.{{0,{size - 1}}}?{packets}")
        sure = F.when(at_start, CERTAIN).when(later, PROBABLE) if sure is None else sure.when(at_start, CERTAIN).when(later, PROBABLE)
    rules.append(_found(sure.isNotNull(), "MpegTs", sure))
    riff, form = F.startswith(head, _bytes(b"RIFF")), F.when(brand == _bytes(b"AVI "), "Avi").otherwise(RAW)
    rules.append(_found(riff, F.when(enough, form).otherwise("Avi"), F.when(enough & (form == "Avi"), CERTAIN).otherwise(PROBABLE)))
    rules.append(_found(F.lit(True), RAW, WEAK))
    found = F.filter(F.array(*rules), lambda x: x.isNotNull())
    # bound to a name by a transform of one element, so that the rules are not repeated in the expression
    return F.flatten(F.transform(F.array(found), lambda some: _by_confidence(F.filter(some, lambda x, i: ~F.exists(F.slice(some, F.lit(1), i), lambda y: y["container"] == x["container"])))))


def _by_confidence(some: Column) -> Column:
    def of(level: int) -> Column:
        return F.filter(some, lambda x: x["confidence"] == level)

    return F.concat(of(CERTAIN), of(PROBABLE), of(WEAK))


def _named(extension: Column, names: dict[str, str]) -> Column:
    found = F.lit(None).cast("string")
    for container, extensions in names.items():
        found = F.when(extension.isin(*extensions.split()), container).otherwise(found)
    return found


def suggested(extension: Column) -> Column:
    """The container that an extension (lower case, without dot) suggests, or null."""
    return _named(extension, SUGGESTED)


def promised(extension: Column) -> Column:
    """The container that an unambiguous extension promises, or null."""
    return _named(extension, PROMISED)


def ranked(found: Column, extension: Column) -> Column:
    """Candidates with the suggested one first among equally sure ones; nothing is added, left out or made surer."""
    first = F.coalesce(suggested(extension), F.lit(""))
    return F.flatten(F.transform(F.array(found), lambda some: _by_confidence(F.concat(F.filter(some, lambda x: x["container"] == first), F.filter(some, lambda x: x["container"] != first)))))


def same_family(a: Column, b: Column) -> Column:
    """Whether two containers have one byte structure."""
    pair = lambda *names: a.isin(*names) & b.isin(*names)
    return (a == b) | pair("Mp4", "FragmentedMp4") | pair("Matroska", "WebM")
