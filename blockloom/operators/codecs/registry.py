"""Codecs by name, cascades of a logical and a physical one, and codecs that users add."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from . import backends as b
from . import logical as l


@dataclass(frozen=True)
class Codec:
    """encode() takes int32 values to bytes, decode() takes bytes and the number of values back.

    ``as_integers`` is the first half of a logical codec, which a cascade feeds to its second stage; a codec
    without it can only be the last stage. ``fused`` codecs leave the sum of the values with the block.
    """

    name: str
    encode: Callable[[np.ndarray], bytes]
    decode: Callable[[bytes, int], np.ndarray]
    as_integers: Callable[[np.ndarray], np.ndarray] | None = None
    from_integers: Callable[[np.ndarray, int], np.ndarray] | None = None
    fused: bool = False


def _u(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values, dtype=np.int32).view(np.uint32)


def _physical(name: str, backend, fused: bool = False) -> Codec:
    return Codec(name, lambda v: backend.encode(_u(v)), lambda d, n: backend.decode(d, n).view(np.int32), fused=fused)


def _logical(name: str, form) -> Codec:
    raw = b.Raw()
    return Codec(
        name,
        lambda v: raw.encode(form.encode(_u(v))),
        lambda d, n: form.decode(raw.decode(d, len(d) // 4), n).view(np.int32),
        lambda v: form.encode(_u(v)).view(np.int32),
        lambda z, n: form.decode(_u(z), n).view(np.int32),
    )


def logical() -> list[Codec]:
    """The twelve logical codecs. Widths differ for the deltas only; the others are one encoding by several names."""
    widths = ("unvec", "vecsse", "vecavx", "vecavx512")
    out = [_logical(f"custom_delta_{w}", l.Delta(g)) for w, g in zip(widths, (1, 4, 8, 16), strict=True)]
    out += [_logical(f"custom_for_{w}", l.Reference()) for w in widths]
    return out + [_logical(f"custom_rle_{w}", l.Runs()) for w in widths]


#: Fixed names: a prefilter and a byte format for each of the nineteen methods of one family.
TURBO = {
    "TurboPFor": ("none", "pfor"), "TurboPFor128": ("none", "pfor"), "TurboPFor256": ("none", "pfor256"),
    "Delta+TurboPFor256": ("delta", "pfor256"), "Delta1+TurboPFor256": ("delta1", "pfor256"), "Zigzag+TurboPFor256": ("zigzag", "pfor256"),
    "TurboPack256": ("none", "pack256"), "Delta+TurboPack256": ("delta", "pack256"), "Delta1+TurboPack256": ("delta1", "pack256"), "Zigzag+TurboPack256": ("zigzag", "pack256"),
    "xor+TurboPack256": ("xor", "pack256"), "zzag/delta+TurboPFor128": ("zigzag", "pfor"),
    "TurboVSimple": ("none", "simple"), "Zigzag+TurboVSimple": ("zigzag", "simple"), "Zigzag/delta_bitio": ("zigzag", "varint"), "Zigzag_bitio": ("zigzag", "varint"),
    "TurboRLE": ("none", "runs"), "Xor+TurboRLE": ("xor", "runs"), "Zigzag+TurboRLE": ("zigzag", "runs"),
}
#: Fixed names of the schemes of another family; their library's full list is not public here.
FAST = {
    "JustCopy": "raw", "BP32": "pack32", "FastBinaryPacking16": "pack16", "FastBinaryPacking32": "pack32", "FastBinaryPacking8": "pack8", "FastPFor128": "pfor", "FastPFor256": "pfor256",
    "NewPFor": "pfor", "OptPFor": "pfor", "PFor": "pfor", "SimplePFor": "pfor", "Simple16": "simple", "Simple8b": "simple", "Simple9": "simple", "SIMDBinaryPacking": "pack128",
    "SIMDFastPFor128": "pfor", "SIMDFastPFor256": "pfor256", "StreamVByte": "stream", "VByte": "varint", "VariableByte": "varint",
}


def _backend(name: str):
    if name.startswith("pack"):
        return b.Bitpack(int(name[4:] or 0))
    return {"pfor": b.PatchedFrame(128), "pfor256": b.PatchedFrame(256), "simple": b.WordAligned(), "varint": b.Varint(), "stream": b.StreamVbyte(), "runs": b.ByteRuns(), "raw": b.Raw()}[name]


def physical() -> list[Codec]:
    """The codecs that may end a cascade, in the order in which a selection lists them."""
    out = [
        _physical("DEFLATE", b.deflate()), _physical("MASKEDVBYTE", b.Varint()), _physical("MASKEDVBYTE_DELTA", b.Prefiltered("delta", b.Varint())), _physical("STREAMVBYTE", b.StreamVbyte()),
        _physical("FrameOfReference", b.Frame()), _physical("FrameOfReference_Turbo", b.Frame(True)), _physical("simdcomp", b.Bitpack()), _physical("simdcomp_fused", b.Bitpack(), True),
        _physical("LZ4", b.lz4()), *[_physical(f"Zstd_{x}", b.zstd(x)) for x in (1, 3, 5)], _physical("LZMA", b.xz()),
    ]
    out += [_physical(f"TurboPFor_{k}", b.Prefiltered(p, _backend(x))) for k, (p, x) in TURBO.items()]
    out += [_physical(f"FastPFor_{k}", _backend(x)) for k, x in FAST.items()]
    return out + [_physical(f"FastPFor_fused_{k}", _backend(x), True) for k, x in FAST.items()]


def direct() -> Codec:
    """No encoding: the block's integers as they are."""
    raw = b.Raw()
    return Codec("custom_direct_access", lambda v: raw.encode(_u(v)), lambda d, n: raw.decode(d, n).view(np.int32), lambda v: v, lambda z, n: z)


def cascade(first: Codec, second: Codec) -> Codec:
    """``first``'s integers encoded by ``second``; the number of those integers goes ahead of the bytes."""
    if first.as_integers is None:
        raise ValueError(f"{first.name} gives bytes, not integers, and so can only end a cascade")

    def encode(v: np.ndarray) -> bytes:
        z = first.as_integers(v)
        return struct.pack("<I", len(z)) + second.encode(z)

    def decode(d: bytes, n: int) -> np.ndarray:
        return first.from_integers(second.decode(d[4:], struct.unpack_from("<I", d)[0]), n)

    return Codec(f"[+]_{first.name}+{second.name}", encode, decode, fused=second.fused)


_ADDED: dict[str, Codec] = {}


def register(codec: Codec) -> None:
    """Adds a codec of the user's own to every later pool."""
    _ADDED[codec.name] = codec


def pool(kind: str = "default") -> list[Codec]:
    """default: logical and physical ones; pipeline: these, cascades of three logical ones with each physical one, and direct access; else the name of a logical codec: its cascades."""
    first = {c.name: c for c in logical()}
    if kind in ("default", ""):
        return [*first.values(), *physical(), *_ADDED.values()]
    if kind == "pipeline":
        heads = [first[f"custom_{x}_vecavx512"] for x in ("delta", "rle", "for")]
        return [*pool(), *[cascade(h, p) for h in heads for p in physical()], direct()]
    if kind not in first:
        raise ValueError(f"no logical codec named {kind!r}")
    return [cascade(first[kind], p) for p in physical()]


def select(codecs: list[Codec], names: list[str]) -> list[Codec]:
    """Those named, in the order of the pool; ["all"] and ["*"] give all, unknown names nothing."""
    if len(names) == 1 and names[0] in ("all", "*"):
        return list(codecs)
    wanted = set(names)
    return [c for c in codecs if c.name in wanted]


def by_name(name: str) -> Codec:
    """A codec of the pools, or any cascade ``[+]_first+second`` of them."""
    m = re.match(r"\[\+\]_([A-Za-z0-9_]+?)\+(.+)\Z", name)
    if m:
        return cascade(by_name(m[1]), by_name(m[2]))
    for codec in (*pool(), direct()):
        if codec.name == name:
            return codec
    raise ValueError(f"no codec named {name!r}")
