"""Causal analytics over sparse hourly entity panels, expressed as Spark jobs."""

from .spec import PanelSpec, UtilityParams, WindowParams, clinical_spec

__all__ = ["PanelSpec", "UtilityParams", "WindowParams", "clinical_spec"]
