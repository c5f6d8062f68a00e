"""What the columns mean and how they are to be prepared."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Roles:
    features: tuple[str, ...] = ()
    label: str | None = None
    id: str | None = None
    exclude: tuple[str, ...] = ()
    user: str | None = None
    item: str | None = None
    rating: str | None = None
    timestamp: str | None = None


@dataclass(frozen=True)
class PrepSpec:
    handle_missing: str = "mean"  # mean | median | drop | zero
    normalization: str = "minmax"  # minmax | standard | none
    outlier_removal: bool = False
    categorical_encoding: str = "label"  # label | onehot

    def __post_init__(self):
        allowed = {
            "handle_missing": ("mean", "median", "drop", "zero"),
            "normalization": ("minmax", "standard", "none"),
            "categorical_encoding": ("label", "onehot"),
        }
        for name, values in allowed.items():
            if getattr(self, name) not in values:
                raise ValueError(f"{name} must be one of {values}")


def _derived(name: str) -> bool:
    return name.startswith("_") or name.startswith("norm_")


def resolve_features(columns: list[str], roles: Roles) -> list[str]:
    """Requested features that exist and have no other role; if none, all remaining source columns."""
    taken = {roles.label, roles.id, roles.user, roles.item, roles.rating, roles.timestamp} - {None}
    wanted = [c for c in roles.features if c in columns and c not in taken]
    return wanted or [c for c in columns if c not in taken and not _derived(c)]


def normalize_roles(columns: list[str], roles: Roles) -> Roles:
    """Explore's reading of the roles: honours ``exclude``, keeps only known columns."""
    label = roles.label if roles.label in columns else None
    taken = {c for c in roles.exclude if c in columns} | {c for c in (label, roles.id) if c in columns}
    wanted = [c for c in roles.features if c in columns and c not in taken]
    features = wanted or [c for c in columns if c not in taken]
    return replace(roles, label=label, features=tuple(features), exclude=tuple(sorted(taken)))


def roles_for_source(columns: list[str], roles: Roles) -> Roles:
    """Roles cut down to the columns a stored Prepare result still has."""
    label = roles.label if roles.label in columns else None
    return replace(roles, label=label, features=tuple(c for c in roles.features if c in columns))


__all__ = ["PrepSpec", "Roles", "normalize_roles", "resolve_features", "roles_for_source"]
