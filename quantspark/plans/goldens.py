"""Published cases that results must agree with: fixed values, as they stand, in natural order."""

from __future__ import annotations

#: Texts and the numbers that they state.
NUMBERS = [
    ("Ce n'est pas un nombre", None),
    ("123", 123.0),
    ("-123", -123.0),
    ("123.456", 123.456),
    ("-123.456", -123.456),
    ("123,456", 123456.0),
    ("9 3/4", 9.75),
    ("9 + 3/4", 9.75),
    ("9 -3/4", 8.25),
    ("9 - 3/4", 8.25),
    ("3*10^6", 3000000.0),
    ("1 million", 1000000.0),
    ("five thousand", 5000.0),
    ("thousand", 1000.0),
    ("billion", 1000000000.0),
    ("one and a half", 1.5),
    ("gazillion", None),
]

#: Sentences with VALUE_TAG before and after each number.
VALUE_TAG = "🍏"
SENTENCES = [
    "It covers an area of 🍏191,123🍏 sq mi, with a population of 🍏15.9 million🍏 as of 2021.",
    "It is 🍏9.1🍏 km long and 🍏9.3🍏 km wide.",
    "The Forschungszentrum Jülich is a member of the Helmholtz Association.",
    "The building costs $🍏32,241,700🍏 to build including the demolition of the roof part.",
    "The geographical mile is determined by 🍏1🍏 minute of arc along the Earth's equator.",
    "Gallium has the atomic number 🍏31🍏.",
    "The national census of 2020 recorded its population as approximately 🍏1,213,456🍏.",
    "The total area is generally stated as being 🍏1,988,213🍏 sq mi.",
    "Earth's mass is around 🍏5,900🍏 Yg.",
    "The Earth is an ellipsoid and has a circumference of ~ 🍏40,000🍏 km.",
    "The highest temperature ever recorded was 🍏39.2🍏 °C on April 01, 1992.",
    "Until 1964, the bridge was the longest suspension bridge with 🍏4200🍏 feet and 🍏67🍏 m clearance above high water.",
    "It is an alga which may grow up in length to 🍏12🍏 metres (🍏39🍏 ft).",
    "Numbers can be written in different ways, e.g., 🍏270🍏 can be written as 🍏2.7×102🍏 or 🍏27×101🍏 or 🍏270×100🍏.",
    "🍏350🍏 can be written as 🍏3.5×10^2🍏 or 🍏35×10^1🍏 or 🍏350×10^0🍏.",
    "🍏350🍏 can be written as 🍏3.5 10²🍏 or 🍏35 10^1🍏 or 🍏350 10^0🍏.",
    "🍏350🍏 can be written as 🍏3.5*10^2🍏 or 🍏35*10^1🍏 or 🍏350*10^0🍏.",
    "🍏3500🍏 can be written as 🍏35.0×10^2🍏 or 🍏350×10^1🍏 or 🍏3,500×10^0🍏.",
    "🍏One🍏, 🍏two🍏 and 🍏three🍏",
]

#: Conversion templates and their full text.
TEMPLATES = [
    ("{{convert|127000<ref>Bledsoe Architects</ref>|sqft|m2|adj=on}}", "127,000-square-foot (11,800 m2)"),
    ("{{convert|20|acre|m2}}", "20 acres (81,000 m2)"),
    ("{{convert|14|m|ft|adj=mid|[[Draft (hull)|draught]]}}", "14-metre draught (46 ft)"),
    ("{{convert|15|km|mi}}", "15 kilometres (9.3 mi)"),
    ("{{convert|1200|km|mi|abbr=on}}", "1,200 km (750 mi)"),
    ("{{convert|32.5|mpgus|L/100 km+mpgus+mpgimp|abbr=on|order=out}}", "7.2 L/100 km (32.5 mpg‑US; 39.0 mpg‑imp)"),
    ("{{convert|130|km/h|mi/h|0|abbr=on}}", "130 km/h (81 mph)"),
    ("{{Convert|40|L|usgal impgal|0|abbr=on }}", "40 L (11 US gal; 9 imp gal)"),
    ("{{convert|50|hp|kW|0|abbr=on}}", "50 hp (37 kW)"),
    ("{{convert|98.1|Nm|lb·ft|abbr=on}}", "98.1 N⋅m (72.4 lb⋅ft)"),
    ("{{convert |100|km/h|mph|0| abbr=on}}", "100 km/h (62 mph)"),
    ("{{convert |1800000|mi|km|abbr=on}}", "1,800,000 mi (2,900,000 km)"),
    ("{{convert |995|cc|cid| abbr =on}}", "995 cc (60.7 cu in)"),
    ("{{convert|0|–|100|km/h}}", "0–100 kilometres per hour (0–62 mph)"),
    ("{{convert|6.7|l/100 km}}", "6.7 litres per 100 kilometres (42 mpg‑imp; 35 mpg‑US)"),
    ("{{cvt|12x14x1|ft|cm|order=flip}}", "366 cm × 427 cm × 30 cm (12 ft × 14 ft × 1 ft)"),
    ("{{cvt|100–120|cm|ftin}}", "100–120 cm (3 ft 3 in – 3 ft 11 in)"),
    ("{{cvt|20–37|kg}}", "20–37 kg (44–82 lb)"),
    ("{{cvt|245–255|mm}}", "245–255 mm (9.6–10.0 in)"),
    ("{{convert|1|e12solar mass|kg|abbr=off|lk=on}}", "1 trillion solar masses (2.0×1042 kilograms)"),
    ("{{convert|2.5|e6ly|kpc|abbr=off|lk=on}}", "2.5 million light-years (770 kiloparsecs)"),
    ("{{convert|220,000|ly|kpc|abbr=on|lk=on}}", "220,000 ly (67 kpc)"),
    ("{{convert|300|km/s|abbr=on}", "300 km/s (190 mi/s)"),
    ("{{Convert|30|km/s|4 = 2|abbr = on}}", "30 km/s (18.64 mi/s)"),
    ("{{Convert| 108000|km/h|abbr = on}}", "108,000 km/h (67,000 mph)"),
    ("{{convert|5|ft|spell=in}}", "five feet (1.5 m)"),
    ("{{Convert|32|m|adj = on|sp = us}}", "32-meter (105 ft)"),
    ("{{convert|62.5|m|ft+royal cubit|abbr=on}}", "62.5 m (205 ft; 119.3 cu)"),
    ("{{convert|60-62.5|m|ft+royal cubit|0|abbr=on}}", "60–62.5 m (197–205 ft; 115–119 cu)"),
    ("{{convert|330,400|m3|ft3|abbr=on}}", "330,400 m3 (11,670,000 cu ft)"),
    ("{{convert|10|and|20|C|6=0}}", "10 and 20 °C (50 and 68 °F)"),
    ("{{convert|0|to|9|mph|km/h|0|abbr=on|order=flip}}", "0 to 14 km/h (0 to 9 mph)"),
    ("{{convert|900|acre|km2|adj=mid|-wide}}", "900-acre-wide (3.6 km2)"),
    ("{{convert|160|km}}", "160 kilometres (99 mi)"),
    ("{{convert|3+1//4|to(-)|4+3//4|lb}}", "3+1/4 to 4+3/4 pounds (1.5–2.2 kg)"),
    ("{{convert|3|to(-)|4+1//2|inch|round=5}}", "3 to 4+1/2 inches (75–115 mm)"),
    ("{{convert|1|to|1+1//3|mi|km}}", "1 to 1+1/3 miles (1.6 to 2.1 km)"),
    ("{{convert|0.35|sqmi|sqkm|2}}", "0.35 square miles (0.91 km2)"),
    ("{{convert|673.7|PD/sqmi|PD/km2|1}}", "673.7 inhabitants per square mile (260.1/km2)"),
    ("{{convert|279.3|/sqmi|/km2|1}}", "279.3 per square mile (107.8/km2)"),
    ("{{convert|1.6|e6sqft|acre_m2}}", "1.6 million square feet (37 acres; 150,000 m2)"),
    ("{{convert|43|kW|abbr=on}}", "43 kW (58 hp)"),
    ("{{convert|198|m|ft|0|abbr=on}}", "198 m (650 ft)"),
    ("{{convert|50|t|lb}}", "50 tonnes (110,000 lb)"),
    ("{{convert|450,000|t|e6lb|abbr=off}}", "450,000 tonnes (990 million pounds)"),
    ("{{convert|1,500|ST|t|order=flip}}", "1,400 tonnes (1,500 short tons)"),
    ("{{convert|20|to|80|m|ft|sp=us}}", "20 to 80 meters (66 to 262 ft)"),
]

#: Conversion templates that must not fail.
TEMPLATES_READ = [
    "{{convert|1234|ft|m|2}}",
    "{{convert|123.4|ft|m|abbr=off|sp=us}}",
    "{{convert|123.4|ft|m|abbr=off}}",
    "{{convert|4|ft||adj=mid|-long}}",
    "{{convert|40|acre||adj=pre|planted}}",
    "{{convert|4|m||disp=preunit|+ }}",
    "{{convert|4|m||disp=preunit|+ |or more }}",
    "{{convert|20|impfloz||disp=x|, approximately }}",
    "{{cvt|12x14x1|ft|cm|order=flip}}",
    "{{convert|100|m||disp=x|/day (|/day)}}",
    "{{convert|62.5|m|ft+royal cubit|0|abbr=on}}",
    "{{convert|100|km|0|adj=mid|in diameter|abbr=on}}",
    "{{convert|32.5|mpgus|L/100 km+mpgus+mpgimp|abbr=on|order=out}}",
    "{{convert|127000<ref>Bledsoe Architects</ref>|sqft|m2|adj=on}}",
    "{{Convert|20|fathom|4 = -deep|adj = mid}}",
    "{{Convert|120-150|C|4=-1|abbr=on|disp=comma}}",
    "{{convert|14|m|ft|adj=mid|[[Draft (hull)|draught]]}}",
    "{{convert|1|e12solar mass|kg|abbr=off|lk=on}}",
    "{{convert|0.8|+/-|0.1|e12solar mass|kg|abbr=on|lk=on}}",
    "{{Convert|30|km/s|4 = 1|abbr = on}}",
    "{{convert|305|acres|km2}}",
    "{{convert|100|km|0|adj=mid|in diameter|abbr=on}}",
    "{{Convert|30|km/s|4 = 1|abbr = on}}",
    "{{convert|35|mi|4=}}",
    "{{convert|1⁄4|mi|m|-1|abbr=on}}",
    "{{convert|¼|mi|m|-1|abbr=on}}",
    "{{convert|²¹/₉₈₇|mi|m|-1|abbr=on}}",
    "{{cvt|1+ 3/8|in}}",
    "{{convert|3//4|in|mm}}",
    "{{convert|1.6|e6sqft|acre_m2}}",
    "{{cvt|61.5|F|C|abbr=values|disp=x|/}}",
]
