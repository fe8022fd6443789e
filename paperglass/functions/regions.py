"""Names of provinces and of the groups of papers that several provinces share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperglass.functions.phrase_match import first_by_order

#: Code, name and short names of the provinces. Each is also known by its name with 卷, but for NM and HL.
_PROVINCES = """
BJ 北京 京
TJ 天津 津
SH 上海 沪
CQ 重庆 渝
HE 河北 冀
SX 山西 晋
NM 内蒙古 蒙 内蒙 内
LN 辽宁 辽
JL 吉林 吉
HL 黑龙江 黑
JS 江苏 苏
ZJ 浙江 浙
AH 安徽 皖
FJ 福建 闽
JX 江西 赣
SD 山东 鲁
HA 河南 豫
HB 湖北 鄂
HN 湖南 湘
GD 广东 粤
GX 广西 桂
HI 海南 琼
SC 四川 川 蜀
GZ 贵州 黔
YN 云南 滇 云
XZ 西藏 藏
SN 陕西 陕 秦
GS 甘肃 甘 陇
QH 青海 青
NX 宁夏 宁
XJ 新疆 新
"""
#: The groups' aliases, the key first, and after the bar their provinces.
_GROUPS = """
全国1 全国I卷 新高考1 新课标I卷 新课标Ⅰ 新课标1 新课标Ⅰ语文 新课标Ⅰ英语 新课标I卷语文 全国I卷语文 | 山东 广东 湖南 湖北 河北 江苏 福建 浙江 河南 江西 安徽
全国2 全国II卷 新高考2 新课标II卷 新课标Ⅱ 新课标2 新课标Ⅱ语文 新课标Ⅱ英语 II卷 | 辽宁 重庆 海南 吉林 黑龙江 山西 云南 广西 甘肃 贵州 新疆 四川 内蒙古 陕西 青海 宁夏 西藏
全国甲卷 全国甲 甲卷 甲卷理科 甲卷文科 | 四川 广西 贵州 西藏 云南 内蒙古 青海 宁夏
全国乙卷 全国乙 乙卷 | 山西 河南 陕西 江西 安徽
黑吉辽蒙 黑吉辽 东北四省 东北 | 黑龙江 吉林 辽宁 内蒙古
陕晋青宁 陕晋宁青 陕晋青宁卷 | 陕西 山西 青海 宁夏
"""
#: The aliases of groups that count inside a text, in the order in which they are looked for.
GROUP_ORDER = "全国1 全国I卷 新课标I卷 新课标Ⅰ 新高考1 全国2 全国II卷 新课标II卷 新课标Ⅱ 新高考2 全国甲卷 全国甲 甲卷 全国乙卷 全国乙 乙卷 黑吉辽蒙 黑吉辽 陕晋青宁 陕晋宁青".split()

CODES = {line.split()[0]: line.split()[1] for line in _PROVINCES.split("\n") if line}
NAMES = {name: [name, *line.split()[2:], *([] if code in ("NM", "HL") else [name + "卷"])] for line in _PROVINCES.split("\n") if line for code, name in [line.split()[:2]]}
ALIASES = {a: name for name, aliases in NAMES.items() for a in aliases}
GROUPS = {line.split()[0]: line.split("|")[0].split() for line in _GROUPS.split("\n") if line}
MEMBERS = {line.split()[0]: line.split("|")[1].split() for line in _GROUPS.split("\n") if line}
GROUP_ALIASES = {a: key for key, aliases in GROUPS.items() for a in aliases}
#: Provinces with the longest alias first, in the order of the table else, and their aliases from long to short.
PROVINCE_ORDER = [(a, name) for name in sorted(NAMES, key=lambda n: -max(map(len, NAMES[n]))) for a in sorted(NAMES[name], key=len, reverse=True)]


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def normalised_region(text: Column) -> Column:
    """A struct (province, group) of a name, one of them set at most: a province by alias, code in any case, or with the ending of a province or
    city, a group by alias."""
    s = F.trim(F.coalesce(text, F.lit("")))
    upper, inner = F.upper(s), F.regexp_extract(s, "^(.*?)(?:省|市|特别行政区)$", 1)
    plain = F.coalesce(_looked_up(ALIASES, s), _looked_up(CODES, upper))
    raised = {**{a.upper(): key for a, key in GROUP_ALIASES.items()}, **GROUP_ALIASES}
    group = F.when(plain.isNull(), F.coalesce(_looked_up(raised, s), _looked_up(raised, upper)))
    ended = F.when(plain.isNull() & group.isNull() & (inner != ""), F.coalesce(_looked_up(ALIASES, inner), _looked_up(CODES, inner)))
    return F.struct(F.coalesce(plain, ended).alias("province"), group.alias("group"))


def group_members(group: Column) -> Column:
    """The provinces of a group by any of its aliases, sorted; empty for no group."""
    table = {**{a.upper(): MEMBERS[key] for a, key in GROUP_ALIASES.items()}, **{a: MEMBERS[key] for a, key in GROUP_ALIASES.items()}}
    known = F.create_map(*(x for a, m in table.items() for x in (F.lit(a), F.array(*map(F.lit, sorted(m))))))
    return F.coalesce(F.try_element_at(known, group), F.try_element_at(known, F.upper(group)), F.array().cast("array<string>"))


def group_in(text: Column) -> Column:
    """The group whose alias stands in a text, by GROUP_ORDER."""
    return first_by_order(text, [(a, GROUP_ALIASES[a]) for a in GROUP_ORDER])


def province_in(text: Column) -> Column:
    """The province whose alias stands in a text, by PROVINCE_ORDER."""
    return first_by_order(text, PROVINCE_ORDER)
