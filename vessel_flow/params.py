"""Pipeline parameters.

The defaults are fixed values that results depend on; they must equal the
reference's constants, so they are listed here plainly and together.
"""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    # --- fixed values (reference defaults) ---------------------------------
    vessel_type_min: int = 70          # freight filter, inclusive
    vessel_type_max: int = 89          # freight filter, inclusive
    tanker_type_min: int = 80          # tanker iff 80 <= type <= 89
    tanker_type_max: int = 89
    smooth_window: int = 3             # centred rolling median, rows
    smooth_min_rows: int = 4           # smooth only vessels with more than 3 rows
    slow_sog: float = 0.3              # knots; SOG < 0.3 is "slow"
    min_stop_hours: float = 1.0        # a slow run counts as a stop if >= 1 h
    merge_gap_hours: float = 1.0       # stops closer than 1 h (strict) merge
    port_radius_deg: float = 0.2       # nearest-port cut-off, degrees of arc, inclusive
    earth_radius_nm: float = 3440.0    # haversine radius, nautical miles
    aux_power_cargo: float = 1776.0    # kW at berth, cargo
    aux_power_tanker: float = 1985.0   # kW at berth, tanker
    main_power_cargo: float = 9300.0   # kW under way, cargo
    main_power_tanker: float = 9400.0  # kW under way, tanker
    sfc_g_per_kwh: float = 213.1       # specific fuel consumption
    co2_factor: float = 3.114          # t CO2 per t fuel
    floor_speed: float = 0.1           # mean speed 0 / missing -> 0.1 kn
    # --- engine choices (not reference values) -----------------------------
    period: str = "year"               # "year" or "month": voyages never cross a period
    state_cell_deg: float = 1.0        # grid cell for the polygon join
    cell_edges: int = 64               # edges of a polygon in one strip of a cell, about
    port_cell_deg: float = 0.5         # grid cell for the port join
    cell_ports: int = 32               # candidate ports of a cell or box, about
    broadcast_max_bytes: int = 256 << 20  # cell tables above this use a shuffle join
    track_partitions: int | None = None  # partitions of the vessel exchange (None: spark.sql.shuffle.partitions)
    split_hot: bool = True             # split vessel-periods with very many rows into row chunks
    hot_vessel_rows: int = 5_000_000   # a vessel-period above this many rows is "hot"
    chunk_rows: int = 2_000_000        # rows per chunk of a hot vessel
    slice_rows: int = 100_000          # fewest rows of a range slice, where there are more slices than partitions

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)

    # Emission rates in t fuel per hour, computed in the same order as the
    # reference: power * sfc * 1e-6.
    def aux_rate(self, tanker: bool) -> float:
        pa = self.aux_power_tanker if tanker else self.aux_power_cargo
        return pa * self.sfc_g_per_kwh * 1e-6

    def main_rate(self, tanker: bool) -> float:
        ps = self.main_power_tanker if tanker else self.main_power_cargo
        return ps * self.sfc_g_per_kwh * 1e-6


DEFAULT = Params()
