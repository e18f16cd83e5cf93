"""Names of orderings, transforms, access patterns and access operations, with their parsers."""

from __future__ import annotations

from enum import Enum


class _Named(Enum):
    """A member's value is its canonical name; ``parse`` also knows the empty name and the aliases of the default."""

    @classmethod
    def parse(cls, text: str):
        if text in cls._other_names():
            return next(iter(cls))
        for member in cls:
            if member.value == text:
                return member
        raise ValueError(f"unknown {cls.__name__}: {text!r}; known are {', '.join(m.value for m in cls)}")

    @classmethod
    def _other_names(cls) -> tuple[str, ...]:
        return ("", "default")

    def __str__(self) -> str:
        return self.value


class Ordering(_Named):
    ROW_MAJOR = "default"
    ZIGZAG = "zigzag"
    MORTON = "morton"


class Transform(_Named):
    NONE = "none"
    THRESHOLD = "Threshold"
    SMOOTH_AND_SHIFT = "SmoothAndShift"
    INDEX_CLASSES = "IndexBasedClassification"
    VALUE_CLASSES = "ValueBasedClassification"
    VALUE_SHIFT = "ValueShift"


class Pattern(_Named):
    LINEAR = "linear"
    RANDOM = "random"


class Access(_Named):
    """What is done to a decoded block: the first six read it, the others change it."""

    XOR = "linearXOR"
    SUM = "linearSum"
    SUM_SIMD = "linearSumSimd"
    SUM_FUSED = "linearSumFused"
    RANDOM_XOR = "randomXOR"
    RANDOM_SUM = "randomSum"
    THRESHOLD = "Threshold"
    SMOOTH_AND_SHIFT = "SmoothAndShift"
    INDEX_CLASSES = "IndexBasedClassification"
    VALUE_CLASSES = "ValueBasedClassification"
    VALUE_SHIFT = "ValueShift"

    @property
    def mutates(self) -> bool:
        return self.transform is not None

    @property
    def transform(self) -> Transform | None:
        return {t.value: t for t in Transform}.get(self.value)
