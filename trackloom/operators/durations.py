"""Least lengths of intervals by lab and action."""

from __future__ import annotations

#: Frames that an interval of `<lab>_<action>` has at least.
LEAST_FRAMES = {
    "CRIM13_attack": 5,
    "CRIM13_sniff": 0,
    "CRIM13_disengage": 10,
    "CRIM13_approach": 5,
    "CRIM13_rear": 6,
    "CRIM13_selfgroom": 5,
    "CRIM13_mount": 5,
    "DeliriousFly_sniff": 6,
    "DeliriousFly_dominance": 7,
    "DeliriousFly_attack": 11,
    "UppityFerret_huddle": 5,
    "UppityFerret_reciprocalsniff": 2,
    "UppityFerret_sniffgenital": 2,
    "TranquilPanther_sniff": 2,
    "TranquilPanther_sniffgenital": 2,
    "TranquilPanther_rear": 8,
    "TranquilPanther_mount": 9,
    "TranquilPanther_intromit": 18,
    "TranquilPanther_selfgroom": 8,
    "LyricalHare_attack": 10,
    "LyricalHare_escape": 6,
    "LyricalHare_defend": 10,
    "LyricalHare_approach": 38,
    "LyricalHare_freeze": 10,
    "LyricalHare_sniff": 10,
    "LyricalHare_rear": 12,
    "ElegantMink_sniff": 5,
    "ElegantMink_mount": 18,
    "ElegantMink_intromit": 49,
    "ElegantMink_allogroom": 38,
    "ElegantMink_ejaculate": 151,
    "ElegantMink_attemptmount": 9,
    "ElegantMink_attack": 8,
    "CalMS21_supplemental_sniff": 2,
    "CalMS21_supplemental_mount": 4,
    "CalMS21_supplemental_intromit": 18,
    "CalMS21_supplemental_sniffgenital": 2,
    "CalMS21_supplemental_attack": 2,
    "CalMS21_supplemental_dominancemount": 8,
    "CalMS21_supplemental_sniffface": 2,
    "CalMS21_supplemental_sniffbody": 2,
    "CalMS21_supplemental_approach": 2,
    "CalMS21_supplemental_attemptmount": 9,
    "SparklingTapir_attack": 4,
    "SparklingTapir_defend": 2,
    "SparklingTapir_escape": 2,
    "SparklingTapir_mount": 10,
    "NiftyGoldfinch_approach": 4,
    "NiftyGoldfinch_sniffface": 2,
    "NiftyGoldfinch_sniff": 2,
    "NiftyGoldfinch_defend": 2,
    "NiftyGoldfinch_rear": 4,
    "NiftyGoldfinch_climb": 6,
    "NiftyGoldfinch_flinch": 3,
    "NiftyGoldfinch_escape": 3,
    "NiftyGoldfinch_selfgroom": 6,
    "NiftyGoldfinch_follow": 8,
    "NiftyGoldfinch_exploreobject": 5,
    "NiftyGoldfinch_chase": 5,
    "NiftyGoldfinch_attack": 4,
    "NiftyGoldfinch_sniffgenital": 3,
    "NiftyGoldfinch_tussle": 11,
    "NiftyGoldfinch_biteobject": 21,
    "NiftyGoldfinch_dig": 6,
    "GroovyShrew_sniff": 2,
    "GroovyShrew_approach": 3,
    "GroovyShrew_rear": 5,
    "GroovyShrew_sniffgenital": 4,
    "GroovyShrew_climb": 10,
    "GroovyShrew_run": 10,
    "GroovyShrew_selfgroom": 8,
    "GroovyShrew_escape": 6,
    "GroovyShrew_dig": 8,
    "GroovyShrew_rest": 25,
    "GroovyShrew_defend": 5,
    "GroovyShrew_attemptmount": 13,
    "BoisterousParrot_shepherd": 15,
    "AdaptableSnail_avoid": 9,
    "AdaptableSnail_chase": 2,
    "AdaptableSnail_attack": 2,
    "AdaptableSnail_chaseattack": 4,
    "AdaptableSnail_rear": 7,
    "AdaptableSnail_approach": 7,
    "AdaptableSnail_submit": 5,
    "CalMS21_task1_sniffbody": 2,
    "CalMS21_task1_approach": 4,
    "CalMS21_task1_sniffface": 3,
    "CalMS21_task1_sniffgenital": 2,
    "CalMS21_task1_mount": 4,
    "CalMS21_task1_genitalgroom": 8,
    "CalMS21_task1_sniff": 2,
    "CalMS21_task1_attack": 4,
    "CalMS21_task1_intromit": 56,
    "PleasantMeerkat_escape": 9,
    "PleasantMeerkat_attack": 9,
    "PleasantMeerkat_chase": 9,
    "PleasantMeerkat_follow": 45,
    "JovialSwallow_sniff": 6,
    "JovialSwallow_attack": 9,
    "JovialSwallow_chase": 9,
    "InvincibleJellyfish_sniffgenital": 2,
    "InvincibleJellyfish_sniff": 2,
    "InvincibleJellyfish_escape": 11,
    "InvincibleJellyfish_dig": 20,
    "InvincibleJellyfish_dominancegroom": 14,
    "InvincibleJellyfish_selfgroom": 10,
    "InvincibleJellyfish_attack": 3,
    "InvincibleJellyfish_allogroom": 13,
    "CalMS21_task2_attack": 2,
    "CalMS21_task2_sniff": 2,
    "CalMS21_task2_mount": 3,
    "ReflectiveManatee_sniff": 4,
    "ReflectiveManatee_attack": 4,
    "CautiousGiraffe_sniff": 4,
    "CautiousGiraffe_sniffgenital": 5,
    "CautiousGiraffe_reciprocalsniff": 4,
    "CautiousGiraffe_sniffbody": 6,
    "CautiousGiraffe_chase": 19,
    "CautiousGiraffe_escape": 9,
}
#: Fixed value: the same for all others.
LEAST_OTHERWISE = 5
