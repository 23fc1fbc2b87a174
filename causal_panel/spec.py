"""What a panel looks like: which columns play which part.

Nothing in the library reads a global; every job is told its panel through a
``PanelSpec`` and its constants through the parameter classes below.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# The channel lists of hourly intensive-care records.
VITALS = ("HR", "O2Sat", "Temp", "SBP", "MAP", "DBP", "Resp", "EtCO2")
LABS = (
    "BaseExcess", "HCO3", "FiO2", "pH", "PaCO2", "SaO2", "AST", "BUN",
    "Alkalinephos", "Calcium", "Chloride", "Creatinine", "Bilirubin_direct",
    "Glucose", "Lactate", "Magnesium", "Phosphate", "Potassium",
    "Bilirubin_total", "TroponinI", "Hct", "Hgb", "PTT", "WBC", "Fibrinogen",
    "Platelets",
)
SPARSE_LABS = ("Lactate", "WBC", "Creatinine", "BUN", "Platelets", "PTT", "Fibrinogen", "TroponinI")
ROLLING_LABS = ("Lactate", "WBC", "Creatinine", "BUN", "Platelets", "Hct", "Glucose", "pH")
STATICS = ("Age", "Gender", "Unit1", "Unit2", "HospAdmTime", "ICULOS")


@dataclass(frozen=True)
class UtilityParams:
    """Time-dependent value of an alert; hours are relative to onset (fixed values)."""

    dt_early: float = -12.0
    dt_optimal: float = -6.0
    dt_late: float = 3.0
    max_u_tp: float = 1.0
    min_u_fn: float = -2.0
    u_fp: float = -0.05
    u_tn: float = 0.0


@dataclass(frozen=True)
class WindowParams:
    """Rolling window lengths in rows (fixed values)."""

    short: int = 6
    medium: int = 12
    long: int = 24

    @property
    def lookback(self) -> int:
        """Rows before the current one that any frame or lag can touch."""
        return max(self.short, self.medium, self.long)


@dataclass(frozen=True)
class PanelSpec:
    """Column roles of an hourly panel.

    ``index`` is the position of a row within its entity, counted from 0 in the
    order of ``order``; ``operators.timeline.index_rows`` derives it when a
    source does not carry it.
    """

    entity: str = "entity"
    order: str = "h"
    index: str = "idx"
    label: str = "y"
    site: str | None = None
    vitals: tuple[str, ...] = ()
    labs: tuple[str, ...] = ()
    sparse_labs: tuple[str, ...] = ()
    rolling_labs: tuple[str, ...] = ()
    statics: tuple[str, ...] = ()
    carried_ids: tuple[str, ...] = ()
    clinical: bool = False
    windows: WindowParams = field(default_factory=WindowParams)

    @property
    def channels(self) -> tuple[str, ...]:
        return self.vitals + self.labs

    @property
    def rolling_channels(self) -> tuple[str, ...]:
        return self.vitals + self.rolling_labs

    @property
    def id_columns(self) -> tuple[str, ...]:
        sited = (self.site,) if self.site else ()
        return (self.entity, *sited, self.order, *self.carried_ids)


def clinical_spec() -> PanelSpec:
    """The 34-channel admission panel: 345 features over seven blocks."""
    return PanelSpec(
        entity="patient_id",
        order="hour",
        label="SepsisLabel",
        site="hospital",
        vitals=VITALS,
        labs=LABS,
        sparse_labs=SPARSE_LABS,
        rolling_labs=ROLLING_LABS,
        statics=STATICS,
        carried_ids=("ICULOS",),
        clinical=True,
    )
