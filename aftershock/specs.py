"""Phase cuts and cohort windows."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

PHASES = ("pre", "crisis", "post")


@dataclass(frozen=True)
class PhaseSpec:
    """The timeline is 'pre' until ``crisis_start``, 'crisis' until ``post_start``, then 'post'."""

    crisis_start: date
    post_start: date

    def __post_init__(self):
        if not self.crisis_start < self.post_start:
            raise ValueError("crisis_start must lie before post_start")

    def require_month_starts(self) -> "PhaseSpec":
        """Marts that join on the month alone need every month to lie in one phase."""
        if self.crisis_start.day != 1 or self.post_start.day != 1:
            raise ValueError("phase cuts must be month starts for month-grain marts")
        return self


@dataclass(frozen=True)
class Span:
    """Half-open range of calendar days, ``[start, end)``."""

    start: date
    end: date

    def __post_init__(self):
        if not self.start < self.end:
            raise ValueError("a span must start before it ends")


@dataclass(frozen=True)
class CohortSpec:
    """Who belongs to the cohort, when they were exposed, and when they must return."""

    name: str
    cohort: Span
    experience: Span
    outcome: Span


def month_shifted(day: date, months: int) -> date:
    """The first of the month ``months`` away."""
    count = day.year * 12 + day.month - 1 + months
    return date(count // 12, count % 12 + 1, 1)


def cohort_of(phases: PhaseSpec, name: str = "cohort") -> CohortSpec:
    """Customers of the month before the crisis, exposed during it, back in the month after it."""
    return CohortSpec(
        name,
        cohort=Span(min(month_shifted(phases.crisis_start, -1), phases.crisis_start), phases.crisis_start),
        experience=Span(phases.crisis_start, phases.post_start),
        outcome=Span(phases.post_start, month_shifted(phases.post_start, 1)),
    )


# The calendar of the analysed incident.
INCIDENT_PHASES = PhaseSpec(date(2025, 6, 1), date(2025, 7, 1))
INCIDENT_COHORT = CohortSpec(
    "may_2025",
    cohort=Span(date(2025, 5, 1), date(2025, 6, 1)),
    experience=Span(date(2025, 6, 1), date(2025, 7, 1)),
    outcome=Span(date(2025, 7, 1), date(2025, 8, 1)),
)
