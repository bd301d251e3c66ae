"""Business parameters. Every operator takes them as arguments; these are the defaults."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta


@dataclass(frozen=True)
class RfmThresholds:
    """Score ladders, best score first."""

    recency: tuple[int, ...] = (30, 60, 90, 180)
    frequency: tuple[int, ...] = (10, 6, 3, 2)
    monetary: tuple[float, ...] = (1_000_000_000, 300_000_000, 100_000_000, 30_000_000)


@dataclass(frozen=True)
class SalesCalendar:
    """Two observed first quarters a year apart, the quarter to forecast and the as-of date."""

    year_a: int = 2025
    as_of: date = date(2026, 3, 31)
    block_months: tuple[int, ...] = (1, 2, 3)
    future_months: tuple[int, ...] = (4, 5, 6)
    snapshot_dates: tuple[date, ...] = (
        date(2025, 1, 31),
        date(2025, 2, 28),
        date(2026, 1, 31),
        date(2026, 2, 28),
        date(2026, 3, 31),
    )

    @property
    def year_b(self) -> int:
        return self.year_a + 1

    def period(self, year: int, month: int) -> int:
        """Absolute month number; January of ``year_a`` is 1."""
        return (year - self.year_a) * 12 + month

    def period_week(self, iso_year: int, iso_week: int) -> int:
        """Absolute week number; week 1 of ``year_a`` is 1."""
        return (iso_year - self.year_a) * 52 + iso_week

    @property
    def quarter(self) -> int:
        """Quarter of the year that both observed blocks are."""
        return (self.block_months[0] - 1) // 3 + 1

    @property
    def periods_a(self) -> list[int]:
        return [self.period(self.year_a, m) for m in self.block_months]

    @property
    def periods_b(self) -> list[int]:
        return [self.period(self.year_b, m) for m in self.block_months]

    @property
    def periods_future(self) -> list[int]:
        return [self.period(self.year_b, m) for m in self.future_months]

    @property
    def last_month_start(self) -> date:
        return date(self.year_b, self.block_months[-1], 1)

    @property
    def future_start(self) -> date:
        return date(self.year_b, self.future_months[0], 1)

    @property
    def future_end(self) -> date:
        last = self.future_months[-1]
        following = date(self.year_b + 1, 1, 1) if last == 12 else date(self.year_b, last + 1, 1)
        return following - timedelta(days=1)


@dataclass(frozen=True)
class Scenarios:
    """Quantity totals of the forecast quarter."""

    totals: dict[str, float] = field(
        default_factory=lambda: {"Conservative": 31956.0, "Base": 37596.0, "Aggressive": 42953.0}
    )


# Fixed values -----------------------------------------------------------------

UNKNOWN_LABEL = "Chưa xác định"
UNCLASSIFIED_LABEL = "Chưa phân loại"
UNKNOWN_CODE = "UNKNOWN"

#: Detailed colour -> base colour. Colours that are not listed stay as they are.
BASE_COLORS = {
    "Đen": "Đen",
    "Đen/Hồng": "Đen/Hồng",
    "Đỏ": "Đỏ",
    "Đỏ Đun": "Đỏ",
    "Đỏ Tươi": "Đỏ",
    "Xanh Dương": "Xanh Dương",
    "Coban": "Xanh Dương",
    "Xanh Santorini": "Xanh Dương",
    "Xanh Nước Biển": "Xanh Dương",
    "Pastel Xanh": "Xanh Dương",
    "Xanh Lá": "Xanh Lá",
    "Rêu": "Xanh Lá",
    "Xanh Ngọc": "Xanh Ngọc/Mint",
    "Ngọc": "Xanh Ngọc/Mint",
    "Xanh Mint": "Xanh Ngọc/Mint",
    "Mint": "Xanh Ngọc/Mint",
    "Xanh": "Xanh",
    "Xanh Tím": "Xanh",
    "Ghi": "Ghi",
    "Hồng": "Hồng",
    "Vàng": "Vàng",
    "Chanh": "Vàng",
    "Cam": "Cam",
    "Trắng": "Trắng",
    "Nâu": "Nâu",
    "Café/Nâu": "Nâu",
    "Kem": "Kem",
    "Be": "Be",
}

#: Substring -> colour, tested in this order on the lower-case product name.
COLOR_WORDS = [
    ("xanh", "Xanh"),
    ("đen", "Đen"),
    ("den", "Đen"),
    ("đỏ", "Đỏ"),
    ("do", "Đỏ"),
    ("cam", "Cam"),
    ("tím", "Tím"),
    ("trắng", "Trắng"),
    ("rêu", "Rêu"),
    ("hồng", "Hồng"),
    ("ghi", "Ghi"),
    ("kem", "Kem"),
    ("coban", "Coban"),
    ("vàng", "Vàng"),
    ("nâu", "Nâu"),
    ("ngọc", "Ngọc"),
    ("be", "Be"),
]

#: Removed one after another from a normalised product key.
KEY_NOISE = [
    "xennpthnngnhnt",
    "xenngthnngnhnt",
    "xedapthongnhat",
    "xedap",
    "xennp",
    "thnngnhnt",
    "thongnhat",
    "xe",
    "te",
]

#: Removed from a line name before it becomes part of a product name.
LICENSE_LITERAL = "(IP - Bản quyền"

#: Tokens of product names damaged by a broken font.
DAMAGED_TOKENS = ["xennpthnngnhnt", "xenngthnngnhnt", "thnngnhnt", "nnp"]

FORECAST_WORDS = [
    "dự báo",
    "dự đoán",
    "kịch bản",
    "forecast",
    "predict",
    "xu hướng",
    "sắp tới",
    "năm tới",
    "năm sau",
    "tháng sau",
    "quý sau",
    "sẽ",
    "tiếp theo",
]
HISTORY_WORDS = ["thống kê", "lịch sử", "đã bán", "thực tế", "hiện tại", "liệt kê"]

#: (patterns that must occur, patterns that must not, target line); first hit wins.
#: ``%`` inside a pattern matches any text; a tuple inside the first list is an "any of".
LINE_RULES = [
    (["GN 06-27 2.0 Pro Shimano"], [], "Xe GN 06-27 2.0 Pro Shimano"),
    (["Super 26"], ["Super 26 S"], "Xe Super 26"),
    (["Super 24"], [], "Xe Super 24"),
    (["Super 20"], ["Man"], "Xe TE Super 20"),
    (["Batman16"], [], "Xe TE Batman16 (IP - Bản quyền)"),
    (["Batman12"], [], "Xe TE Batman12 (IP - Bản quyền)"),
    (["Bubbles 20"], [], "Xe Neo 20-02 Bubble"),
    (["RPD 700C"], ["V5", "CPD"], "Xe Road RPD 700C"),
    ([("GRX AT 27,5%2.0", "GRX AT 27.5%2.0")], [], "Xe GRX AT 27,5_2.0"),
    (["The Flash"], [], "Xe FLASH (IP - Bản quyền)"),
    (["New 26"], [], "Xe New 26"),
    (["New 24"], [], "Xe New 24"),
    (["LD 24-02"], [], "Xe LD 24-02"),
    (["Neo 20-03"], [], "Xe Neo 20-03"),
    (["LD 24-01"], [], "Xe LD 24-01_2023"),
    ([("MTB 26-02", "MTB 26 02")], [], "Xe MTB 26 02"),
    (["LD 26"], [], "Xe LD 26"),
    (["SPD 27.5", "MTB"], [], "Xe MTB SPD 27.5"),
    (["Nữ"], [], "Xe Nữ"),
    (["Super Man 12"], [], "Xe TE Super Man 12 (IP - Bản quyền)"),
    (["Super Man 16"], [], "Xe TE Super Man 16 (IP - Bản quyền)"),
    (["Powerpuff%12"], [], "Xe TE Powerpuff Girls 12 (IP - Bản quyền)"),
    (["Wonder Woman 20"], [], "Xe TE Wonder Woman 20 (IP - Bản quyền)"),
    (["GN 06%24"], ["2.0"], "Xe GN 06-24"),
    (["GN 06%26"], ["2.0"], "Xe GN 06-26"),
    (["nam"], ["superman", "batman"], "Xe Nam"),
]

SEGMENT_WEIGHTS = {
    "Champions": 1.25,
    "Loyal": 1.15,
    "Big Spender": 1.25,
    "Potential": 1.00,
    "New": 0.85,
    "At Risk": 1.20,
    "Hibernating": 0.80,
    "Lost": 0.50,
}
DEFAULT_SEGMENT_WEIGHT = 0.75

ACTIONS = {
    "protect": "Protect & upsell: chăm sóc VIP, gợi ý nhóm sản phẩm bổ sung",
    "account": "Account care: duy trì quan hệ, không ép tần suất, nhắc chu kỳ đặt hàng lớn",
    "win_back": "Urgent win-back: gọi trực tiếp, ưu đãi giữ chân",
    "decline": "Decline intervention: kiểm tra nguyên nhân giảm mua",
    "restock": "Restock reminder: nhắc đặt hàng, đề xuất SKU bán chạy",
    "New": "Onboarding: follow-up đơn đầu, hướng dẫn danh mục bán chạy",
    "Potential": "Nurturing: khuyến mãi lần mua tiếp theo, cross-sell",
    "At Risk": "Retention call: liên hệ kiểm tra nhu cầu, đề xuất ưu đãi giữ chân",
    "Hibernating": "Reactivation campaign: ưu đãi quay lại, khảo sát lý do ngừng mua",
    "Lost": "Low-cost nurture: giữ liên hệ chi phí thấp, không ưu tiên sales trực tiếp",
    "monitor": "Monitor: theo dõi thêm, chưa cần hành động mạnh",
}

ASP_SOURCES = [
    "a. SKU latest effective price",
    "b. SKU latest transaction unit_price",
    "c. group-level latest effective ASP",
    "d. group-level latest transaction ASP",
    "e. overall latest ASP",
]

FEATURE_SETS = {
    "monthly_minimal_features": [
        "base_color", "fiscal_month", "group_code_clean", "implied_price_lag1", "is_cold_start_march_sku",
        "is_unknown_hierarchy", "qty_lag_1", "qty_lag_2", "sku_share_in_group_lagged",
    ],
    "monthly_extended_features": [
        "avg_qty_per_dealer_lag1", "base_color", "color", "days_in_month", "fiscal_month", "group_code_clean",
        "group_total_quantity_lagged", "implied_price_lag1", "is_cold_start_march_sku", "is_q1", "is_q2",
        "is_unknown_hierarchy", "line_id_clean", "median_unit_price_lag1", "n_dealers_lag1", "n_provinces_lag1",
        "n_regions_lag1", "qty_lag_1", "qty_lag_2", "sku_share_in_group_lagged", "sku_share_total_lagged",
    ],
    "weekly_minimal_features": [
        "base_color", "fiscal_month", "group_code_clean", "is_cold_start_march_sku", "is_unknown_hierarchy",
        "median_unit_price_lag_1w", "qty_lag_1w", "qty_lag_2w", "qty_lag_4w", "qty_roll_mean_2w",
        "qty_roll_mean_4w",
    ],
    "weekly_extended_features": [
        "base_color", "color", "fiscal_month", "group_code_clean", "implied_price_lag_1w",
        "is_cold_start_march_sku", "is_unknown_hierarchy", "line_id_clean", "median_unit_price_lag_1w",
        "n_dealers_lag_1w", "qty_lag_1w", "qty_lag_2w", "qty_lag_4w", "qty_roll_mean_2w", "qty_roll_mean_4w",
    ],
}

#: feature, family, grain, type, in minimal set, in extended set, needs a shift
FEATURE_REGISTRY = [
    ("fiscal_year", "calendar", "both", "int", True, True, False),
    ("fiscal_month", "calendar", "both", "int", True, True, False),
    ("month_sin", "calendar", "both", "float", True, True, False),
    ("month_cos", "calendar", "both", "float", True, True, False),
    ("is_q1", "calendar", "monthly", "int", False, True, False),
    ("is_q2", "calendar", "monthly", "int", False, True, False),
    ("days_in_month", "calendar", "monthly", "int", False, True, False),
    ("group_code_clean", "static", "both", "string", True, True, False),
    ("base_color", "static", "both", "string", True, True, False),
    ("color", "static", "both", "string", False, True, False),
    ("is_unknown_hierarchy", "static", "both", "int", True, True, False),
    ("qty_lag_1", "lag", "monthly", "float", True, True, True),
    ("qty_lag_2", "lag", "monthly", "float", True, True, True),
    ("sku_share_in_group_lagged", "hierarchy_share", "monthly", "float", True, True, True),
    ("n_dealers_lag1", "dealer", "monthly", "float", False, True, True),
    ("implied_price_lag1", "pricing", "monthly", "float", False, True, True),
]

#: Columns that are, or are derived from, the value to predict.
TARGET_DERIVED = [
    "total_quantity", "total_revenue", "is_zero_sales_row", "n_orders", "n_transactions", "n_dealers",
    "n_provinces", "n_regions", "median_unit_price", "implied_price",
]

#: last known value -> lag feature, for future rows that carry frozen values
FUTURE_ALIASES = {
    "last_known_qty_1": "qty_lag_1",
    "last_known_qty_2": "qty_lag_2",
    "last_known_n_dealers_1": "n_dealers_lag1",
    "last_known_price_1": "implied_price_lag1",
    "last_known_qty_1w": "qty_lag_1w",
    "last_known_qty_2w": "qty_lag_2w",
    "last_known_qty_4w": "qty_lag_4w",
    "last_known_n_dealers_1w": "n_dealers_lag_1w",
    "last_known_median_unit_price_1w": "median_unit_price_lag_1w",
}

DEALER_FEATURES = [
    "recency_days", "frequency", "monetary", "avg_order_size", "n_skus_bought", "n_groups_bought",
    "avg_unit_price", "is_new_dealer", "qty_momentum", "revenue_momentum",
]

#: Closed bins; ``None`` leaves the last one open.
RECENCY_BINS = [(0, 7), (8, 14), (15, 30), (31, 60), (61, 90), (91, 180), (181, 365), (366, None)]
FREQUENCY_BINS = [(1, 1), (2, 2), (3, 3), (4, 5), (6, 9), (10, 19), (20, 49), (50, None)]
MONETARY_EDGES = [0, 5e6, 10e6, 30e6, 50e6, 100e6, 300e6, 500e6, 1e9, 5e9]
DESCRIBE_PERCENTS = [5, 10, 20, 25, 30, 40, 50, 60, 70, 75, 80, 90, 95, 99]

# Fixed texts of the slow-moving report; period names come from the calendar, <names> from the row.
SLOW_MOVING_REASONS = {
    "new_or_uncertain": "SKU appeared very recently ({month} or {quarter}) with no {before_short} history.",
    "red_no_demand": "{quarter} total_quantity = 0.",
    "amber_slow_moving": "{quarter} qty (<quantity>) is <= group P10/10 threshold (<limit>).",
    "declining_activity": "{quarter} qty dropped by <drop>% vs {before}.",
}
SLOW_MOVING_NORMAL = "Normal activity."
SLOW_MOVING_ACTIONS = {
    "new_or_uncertain": "Monitor demand closely. Do not classify as slow-moving yet.",
    "red_no_demand": "Phase out or stop production unless required for strategic reasons.",
    "amber_slow_moving": "Deprioritize in production. Liquidate excess inventory.",
    "declining_activity": "Review marketing/pricing. Reduce production forecast.",
}
SLOW_MOVING_DEFAULT = "Follow {next} forecast."
