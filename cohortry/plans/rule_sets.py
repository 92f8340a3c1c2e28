"""Rule sets shipped as data."""

from __future__ import annotations

#: Thresholds of the built-in behaviour rules.
MULTI_DAY, BRAND_SEARCHES, DEALER_SECONDS, SEARCH_SECONDS = 3, 2, 1800, 3000

SEARCH = ["search_vertical", "search_general"]


def _raw(kind, stat="exists", value=None, op=">=", **more):
    return {"raw": kind, "stat": stat, "op": op, "value": value, **more}


def _count(kind, n, **more):
    return _raw(kind, "count", n, **more)


def _both(*kinds):
    return {"all": [_count(k, 1) for k in kinds]}


_WITH_BRAND = {"where": [("brand", "not null", None)]}

# Names and thresholds of the built-in behaviour rules.
BEHAVIOUR_RULES: dict[str, dict] = {
    "multi_day_search": _raw(SEARCH, "days", MULTI_DAY),
    "brand_focused_search": _count(SEARCH, BRAND_SEARCHES, **_WITH_BRAND),
    "high_freq_search": _count(SEARCH, 10),
    "vertical_search_user": _count("search_vertical", 2),
    "entertainment_search_user": _count("search_entertainment", 2),
    "high_engagement_search": _raw("search_general", "dur_max", SEARCH_SECONDS),
    "multi_brand_search": _raw(SEARCH, "distinct", 3, attr="brand"),
    "detail_view_user": _count("view_car_detail", 2),
    "loan_calc_user": _count("view_loan_calc", 1),
    "car_compare_user": _count("view_car_compare", 1),
    "floor_price_user": _count("view_floor_price", 1),
    "contact_sales_user": _count("view_contact_sales", 1),
    "short_video_car_user": _count("view_short_video", 2),
    "multi_model_detail": _raw("view_car_detail", "distinct", 3, attr="model"),
    "ad_click_user": _count("ad_click", 1),
    "multi_ad_click": _count("ad_click", 3),
    "brand_ad_click": _count("ad_click", 1, **_WITH_BRAND),
    "pass_dealership_intent": {"any": [_count("pass_dealership", 2), _raw("pass_dealership", "dur_max", DEALER_SECONDS, ">")]},
    "pass_dealership_once": _count("pass_dealership", 1),
    "map_app_power_user": _count("map_app_use", 5),
    "rental_car_user": _count("rental_app_use", 1),
    "test_drive_user": _count("test_drive", 1),
    "order_placed_user": _count("order_placed", 1),
    "search_then_detail": _both(SEARCH, "view_car_detail"),
    "detail_view_with_loan": _both("view_car_detail", "view_loan_calc"),
    "detail_and_compare": _both("view_car_detail", "view_car_compare"),
    "detail_and_floor_price": _both("view_car_detail", "view_floor_price"),
    "search_and_ad_click": _both(SEARCH, "ad_click"),
    "search_and_dealership": _both(SEARCH, "pass_dealership"),
    "contact_sales_with_detail": _both("view_contact_sales", "view_car_detail"),
    "video_then_search": _both("view_short_video", SEARCH),
    "test_drive_with_search": _both("test_drive", SEARCH),
    "map_and_dealership": _both("map_app_use", "pass_dealership"),
    "full_funnel_user": _both(SEARCH, "view_car_detail", "view_loan_calc", "pass_dealership"),
}

#: Rules over all kinds of events are columns of their own (see ``operators.audience.totals``).
TOTAL_RULES = {
    "high_total_actions": ("n_events", 20),
    "multi_event_type_user": ("n_types", 4),
    "long_total_duration": ("total_dwell", 3600),
    "recent_30day_multi_action": ("n_recent_types", 3),
}


def _exists(*kinds):
    return {"any": [_raw(k) for k in kinds]}


def _says(**of):
    return {"any": [_raw(k, "contains", w) for k, words in of.items() for w in words]}


def _acts(*names):
    return [{"event": n, "stat": "exists"} for n in names]


# The action rules with the number of hits that saturates them.
ACTION_RULES: dict[str, tuple[dict, int]] = {
    "Action_Calculate_Car_Loan": ({"any": [_raw("view_loan_calc", "dur_max", 30), _raw("view_floor_price", "dur_max", 30)]}, 2),
    "Action_Book_Car_Test_Drive": (_exists("test_drive", "view_contact_sales"), 1),
    "Action_Compare_Car_Models": ({"all": [{"before": ("search_vertical", "view_car_compare")}, _raw("view_car_compare")]}, 2),
    "Action_Browse_Car_Detail_Freq": ({"all": [_raw("view_car_detail", "days", 2), _raw("view_car_detail", "dur_max", 120)]}, 5),
    "Action_Browse_Car_News_Gen": ({"any": [_count("search_general", 3), _count("view_short_video", 2)]}, 8),
    "Action_Consume_Car_Entertain": ({"all": [_count("search_entertainment", 2), {"not": _exists("search_vertical", "view_car_detail", "view_loan_calc")}]}, 5),
    "Action_Nav_To_Car_Dealer": ({"all": [_raw("pass_dealership"), _raw("map_app_use")]}, 2),
    "Action_Nav_Commute_Route": (_raw("map_app_use", "days", 5), 10),
    "Action_Nav_To_Outdoor_Scenic": (_count("map_app_use", 3), 6),
    "Action_Nav_Intercity_Or_Airport": ({"any": [_raw("rental_app_use"), _count("map_app_use", 5)]}, 4),
    "Action_Search_Car_Space_Seat": (_says(search_vertical=["6座", "7座", "MPV"], search_general=["6座", "7座", "MPV"], view_car_detail=["6座", "7座"]), 3),
    "Action_Search_Car_ADAS_Tech": (_says(search_vertical=["NOA", "自动泊车", "激光雷达"], search_general=["NOA", "自动泊车"], view_car_detail=["NOA"], view_car_compare=["激光雷达"]), 3),
    "Action_Search_Car_Offroad_Perf": (_says(search_vertical=["底盘", "三把锁", "涉水"], search_general=["底盘", "零百"], view_car_detail=["三把锁"]), 3),
    "Action_Search_Car_Crash_Safety": (_says(search_vertical=["中保研", "AEB"], search_general=["中保研", "气囊"], view_car_compare=["AEB"], view_car_detail=["气囊"]), 3),
    "Action_Browse_Luxury_Car_Brand": (
        {"any": [_raw("view_car_detail", where=[("brand", "=", "BBA")]), _raw("view_car_compare", where=[("brand", "=", "BBA")]), _says(search_vertical=["奔驰", "宝马", "奥迪", "保时捷"])]},
        3,
    ),
    "Action_Search_Car_Discount": (_says(search_general=["降价", "补贴", "免息", "落地价"], search_vertical=["降价", "大跳水"]), 4),
    "Action_Search_Car_EV_Range": (_says(search_general=["续航", "充电桩", "插混", "增程"], search_vertical=["续航"], view_car_detail=["续航"]), 4),
    "Action_Interact_Maternity_Baby": (_count("map_app_use", 1), 3),
}

DETAIL, COMPARE, SPACE, ADAS = "Action_Browse_Car_Detail_Freq", "Action_Compare_Car_Models", "Action_Search_Car_Space_Seat", "Action_Search_Car_ADAS_Tech"
RANGE, LUXURY, OFFROAD, SAFETY = "Action_Search_Car_EV_Range", "Action_Browse_Luxury_Car_Brand", "Action_Search_Car_Offroad_Perf", "Action_Search_Car_Crash_Safety"
COMMUTE, OUTDOOR, INTERCITY, DISCOUNT = "Action_Nav_Commute_Route", "Action_Nav_To_Outdoor_Scenic", "Action_Nav_Intercity_Or_Airport", "Action_Search_Car_Discount"
BABY, LOAN = "Action_Interact_Maternity_Baby", "Action_Calculate_Car_Loan"


def _all(*names, more=()):
    return {"all": [*_acts(*names), *more]}


def _profile(field, *values):
    return {"profile": field, "op": "in", "value": list(values)}


def _not(name):
    return {"not": _acts(name)[0]}


# The need rules with their weights.
NEED_RULES: dict[str, tuple[dict, float]] = {
    "Need_Flexible_Solo_Commute": (_all(COMMUTE, DETAIL, more=[_not(SPACE)]), 0.8),
    "Need_Child_Safety_Cabin": (_all(BABY, SPACE), 0.9),
    "Need_High_Capacity_Space": (_all(SPACE, COMPARE), 0.85),
    "Need_Elderly_Mobility_Access": (_all(SPACE, more=[_profile("age_group", "45-54岁", "55岁以上")]), 0.7),
    "Need_Newborn_Health_Protect": (_all(BABY, SAFETY), 0.9),
    "Need_Urban_Short_Trip_Park": (_all(COMMUTE, "Action_Browse_Car_News_Gen"), 0.75),
    "Need_Retirement_Road_Trip": (_all(OUTDOOR, more=[_profile("age_group", "55岁以上")]), 0.7),
    "Need_Luggage_Intercity_Trip": (_all(INTERCITY, more=[{"any": _acts(DETAIL, RANGE)}]), 0.85),
    "Need_Advanced_Auto_Driving": (_all(ADAS, more=[{"any": _acts(COMPARE, DETAIL)}]), 0.9),
    "Need_Extreme_Track_Handling": (_all(OFFROAD, DETAIL), 0.8),
    "Need_Ultra_Long_Range_Fatigue": (_all(INTERCITY, more=[{"any": _acts(RANGE, ADAS)}]), 0.85),
    "Need_Hardcore_Offroad_Escape": (_all(OUTDOOR, OFFROAD), 0.8),
    "Need_Outdoor_Camping_Power": (_all(OUTDOOR, SPACE), 0.75),
    "Need_Top_Tier_Crash_Safety": (_all(SAFETY, COMPARE), 0.85),
    "Need_Immersive_Cabin_Audio": (_all(ADAS, DETAIL), 0.7),
    "Need_Extreme_Climate_Adapt": (_all(RANGE, more=[_profile("city", "哈尔滨市", "长春市", "沈阳市", "乌鲁木齐市", "海口市", "三亚市")]), 0.8),
    "Need_Traffic_Jam_Smooth_Drive": (_all(COMMUTE, RANGE), 0.8),
    "Need_Smart_Cabin_Voice_Ctrl": (_all(ADAS, DETAIL), 0.85),
    "Need_First_Car_Aesthetics": (_all(DISCOUNT, DETAIL, more=[_profile("age_group", "18-24岁")]), 0.8),
    "Need_Business_Social_Prestige": (_all(LUXURY, more=[_profile("consume_freq", "较高频")]), 0.85),
    "Need_Luxury_Brand_Upgrading": (_all(LUXURY, COMPARE, more=[{"profile": "car_status", "op": "=", "value": "有车"}]), 0.9),
    "Need_Low_Profile_Practicality": (_all(COMPARE, more=[_not(LUXURY), _profile("consume_freq", "较高频", "中频")]), 0.7),
    "Need_Niche_Visual_Individuality": (_all("Action_Consume_Car_Entertain", DETAIL), 0.7),
    "Need_Racing_Culture_Modification": (_all(OFFROAD, DETAIL), 0.75),
    "Need_Domestic_Tech_Patriotism": (_all(ADAS, more=[_not(LUXURY), _says(search_vertical=["比亚迪", "华为", "理想", "蔚来"])]), 0.8),
    "Need_Absolute_Lowest_Price": (_all(LOAN, DISCOUNT), 0.9),
    "Need_Max_Spec_Cost_Performance": (_all(DISCOUNT, COMPARE), 0.85),
    "Need_High_Resale_Value_Protect": (_says(search_general=["保值率", "二手"], search_vertical=["保值率"]), 0.8),
    "Need_Lifetime_Warranty_WorryFree": (_all(COMPARE, more=[_says(search_general=["通病", "维修费", "保养"])]), 0.8),
    "Need_License_Plate_Policy_Bypass": (_all(RANGE, LOAN, more=[_profile("city_tier", "一线", "新一线")]), 0.9),
}
