"""Settings with their bounds, presets, and what depends on them alone."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ScanSettings:
    contrast: float = 1.0
    brightness: float = 0.0
    sharpen: float = 0.0
    denoise: bool = False
    binarize: bool = False
    auto_rotate: bool = True
    handwritten: bool = False
    engine: str = "ML_KIT"
    confidence_threshold: float = 0.0

    def __post_init__(self) -> None:
        for name, low, high in (("contrast", 0.1, 5.0), ("brightness", -255.0, 255.0), ("sharpen", 0.0, 5.0), ("confidence_threshold", 0.0, 1.0)):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be from {low} to {high}, not {getattr(self, name)}")

    @property
    def has_filters(self) -> bool:
        return (self.contrast, self.brightness, self.sharpen) != (1.0, 0.0, 0.0) or self.denoise or self.binarize

    def forced_binarize(self) -> ScanSettings:
        return replace(self, binarize=True)


# Presets of scan settings, and of document preparation by kind of image.
SCAN_PRESETS = {
    "DEFAULT": ScanSettings(),
    "DOCUMENT": ScanSettings(contrast=1.5, sharpen=0.5, denoise=True),
    "RECEIPT": ScanSettings(contrast=1.8, sharpen=0.5, denoise=True, binarize=True),
    "SCREENSHOT": ScanSettings(),
}


@dataclass(frozen=True)
class Preparation:
    contrast_factor: float | None = 1.5
    sharpen: bool = True
    denoise: bool = False
    binarize: int | None = None
    adaptive: bool = False
    background: bool = False
    least_side: int = 800
    most_side: int = 2048

    def apply(self, pixels: DataFrame) -> DataFrame:
        from ..operators.images import document_pipeline

        return document_pipeline(pixels, background=self.background, contrast_factor=self.contrast_factor, denoise=self.denoise, sharp=self.sharpen, adaptive=self.adaptive, binarize=self.binarize)


PREPARATIONS = {
    "GENERAL": Preparation(contrast_factor=1.4),
    "WHITE_PAPER": Preparation(contrast_factor=1.6, background=True),
    "RECEIPT": Preparation(contrast_factor=1.8, adaptive=True, least_side=1200),
    "SIGN": Preparation(contrast_factor=1.3, denoise=True),
    "SCREENSHOT": Preparation(contrast_factor=None, sharpen=False),
}


def engine_of_type(kind: Column) -> Column:
    """The engine of a setting; barcodes are not for these engines."""
    return F.when(kind == "ML_KIT", "mlkit").when(kind == "TESSERACT", "tesseract").when(kind == "HYBRID", "hybrid").otherwise(F.raise_error(F.concat(F.lit("no recognition engine for "), F.coalesce(kind, F.lit("null")))))


def engine_of_name(name: Column) -> Column:
    """The engine of a name in any case; unknown names are the hybrid one."""
    upper = F.upper(name)
    return F.when(upper == "MLKIT", "mlkit").when(upper == "TESSERACT", "tesseract").otherwise("hybrid")


class TextStep(Protocol):
    """A step of text processing that others can add: a name, whether it applies to a row, and the new text."""

    name: str

    def applies(self, document_type: Column) -> Column: ...

    def process(self, text: Column) -> Column: ...


def run_steps(text: Column, document_type: Column, steps: list[TextStep]) -> Column:
    for step in steps:
        text = F.when(F.coalesce(step.applies(document_type), F.lit(True)), step.process(text)).otherwise(text)
    return text


Decoder = Callable[[DataFrame], DataFrame]
"""A recognition or barcode engine from outside: image rows in, word or payload rows out."""
