"""Lossless integer codecs: a registry of logical, physical, direct and cascaded ones."""

from .registry import Codec, cascade, logical, physical, pool, register, select

__all__ = ["Codec", "cascade", "logical", "physical", "pool", "register", "select"]
