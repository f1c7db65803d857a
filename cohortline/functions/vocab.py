"""Vocabularies. Every list below is a set of fixed values: results depend on them being exactly these."""

# Flowsheet paths that record urine, without their common prefix.
URINE_PREFIX = "flowsheet|Flowsheet Cell Labels|I&O|Output (ml)|"
URINE_CELLS = (
    "Urine",
    "3 way foley",
    "3 Way Foley",
    "Actual Urine",
    "Adjusted total UO NOC end shift",
    "BRP (urine)",
    "BRP (Urine)",
    "condome cath urine",
    "diaper urine",
    "inc of urine",
    "incontient urine",
    "Incontient urine",
    "Incontient Urine",
    "incontinence of urine",
    "Incontinence-urine",
    "incontinence/ voids urine",
    "incontinent of urine",
    "INCONTINENT OF URINE",
    "Incontinent UOP",
    "incontinent urine",
    "Incontinent (urine)",
    "Incontinent Urine",
    "incontinent urine counts",
    "incont of urine",
    "incont. of urine",
    "incont. of urine count",
    "incont urine",
    "incont. urine",
    "Incont. urine",
    "Incont. Urine",
    "inc urine",
    "inc. urine",
    "Inc. urine",
    "Inc Urine",
    "indwelling foley",
    "Indwelling Foley",
    "Straight Catheter-Foley",
    "Straight Catheterization Urine",
    "Straight Cath UOP",
    "straight cath urine",
    "Straight Cath Urine",
    "strait cath Urine",
    "Suprapubic Urine Output",
    "true urine",
    "True Urine",
    "True Urine out",
    "unmeasured urine",
    "Unmeasured Urine",
    "unmeasured urine output",
    "Urethal Catheter",
    "Urethral Catheter",
    "urinary output 7AM - 7 PM",
    "urinary output 7AM-7PM",
    "urine",
    "URINE",
    "URINE CATHETER",
    "Intermittent/Straight Cath (mL)",
    "straightcath",
    "straight cath",
    "Straight cath",
    "Straight  cath",
    "Straight Cath",
    "Straight  Cath",
    "Straight Cath'd",
    "straight cath daily",
    "straight cathed",
    "Straight Cathed",
    "Straight catheterization",
    "Straight Catheter Output",
    "Straight Catheter-Straight Catheter",
    "straight cath ml's",
    "Straight cath ml's",
    "Straight Cath Q6hrs",
    "Straight caths",
    "Urine Output-straight cath",
    "Urine-straight cath",
    "Urine Straight Cath",
    "Condom Catheter",
    "condom catheter",
    "condom cath",
    "Condom Cath",
    "CONDOM CATHETER OUTPUT",
    "Urine via condom catheter",
    "Urine-foley",
    "Urine- foley",
    "Urine- Foley",
    "Urine foley catheter",
    "Urine, L neph:",
    "Urine (measured)",
    "urine output",
    "Urine Output-external catheter",
    "Urine Output-foley",
    "Urine Output-Foley",
    "Urine Output-FOLEY",
    "Urine Output-Foley cath",
    "Urine Output-FOLEY CATH",
    "Urine Output-foley catheter",
    "Urine Output-Foley Catheter",
    "Urine Output-FOLEY CATHETER",
    "Urine Output-Foley Output",
    "Urine Output-Fpley",
    "Urine Output-Ileoconduit",
    "Urine Output-left nephrostomy",
    "Urine Output-Left Nephrostomy",
    "Urine Output-Left Nephrostomy Tube",
    "Urine Output-LEFT PCN TUBE",
    "Urine Output-L Nephrostomy",
    "Urine Output-L Nephrostomy Tube",
    "Urine Output-Nephrostomy",
    "Urine Output-right nephrostomy",
    "Urine Output-RIGHT Nephrouretero Stent Urine Output",
    "Urine Output-R nephrostomy",
    "Urine Output-R Nephrostomy",
    "Urine Output-R. Nephrostomy",
    "Urine Output-R Nephrostomy Tube",
    "Urine Output-Rt Nephrectomy",
    "Urine Output-stent",
    "Urine Output-suprapubic",
    "Urine Output-Texas Cath",
    "Urine Output-Urine",
    "Urine Output-Urine Output",
    "Urine, R neph:",
    "urine (void)",
    "Urine- void",
    "Urine, void:",
)

# Path patterns that record urine beside the list above, and what disqualifies a catheter cell.
URINE_CATHETER_PREFIX = "foley%"
URINE_CATHETER_NOT = ("%pacu%", "%or%", "%ir%")
URINE_PATTERNS = (
    "Output%Urinary Catheter%",
    "Output%Urethral Catheter%",
    "Urine Output (mL)%",
    "Output%External Urethral%",
    "Urinary Catheter Output%",
)

# Airway types, charted words and treatments that show mechanical ventilation.
INVASIVE_AIRWAYS = ("Oral ETT", "Nasal ETT", "Tracheostomy")
VENTILATOR_PATTERNS = (
    "%ventilator%",
    "%vent%",
    "%bipap%",
    "%840%",
    "%cpap%",
    "%drager%",
    "mv%",
    "%servo%",
    "%peep%",
)
VENTILATION_TREATMENTS = (
    "pulmonary|ventilation and oxygenation|mechanical ventilation",
    "pulmonary|ventilation and oxygenation|tracheal suctioning",
    "pulmonary|ventilation and oxygenation|ventilator weaning",
    "pulmonary|ventilation and oxygenation|mechanical ventilation|assist controlled",
    "pulmonary|radiologic procedures / bronchoscopy|endotracheal tube",
    "pulmonary|ventilation and oxygenation|oxygen therapy (> 60%)",
    "pulmonary|ventilation and oxygenation|mechanical ventilation|tidal volume 6-10 ml/kg",
    "pulmonary|ventilation and oxygenation|mechanical ventilation|volume controlled",
    "surgery|pulmonary therapies|mechanical ventilation",
    "pulmonary|surgery / incision and drainage of thorax|tracheostomy",
    "pulmonary|ventilation and oxygenation|mechanical ventilation|synchronized intermittent",
    "pulmonary|surgery / incision and drainage of thorax|tracheostomy|performed during current admission for ventilatory support",
    "pulmonary|ventilation and oxygenation|ventilator weaning|active",
    "pulmonary|ventilation and oxygenation|mechanical ventilation|pressure controlled",
    "pulmonary|ventilation and oxygenation|mechanical ventilation|pressure support",
    "pulmonary|ventilation and oxygenation|ventilator weaning|slow",
    "surgery|pulmonary therapies|ventilator weaning",
    "surgery|pulmonary therapies|tracheal suctioning",
    "pulmonary|radiologic procedures / bronchoscopy|reintubation",
    "pulmonary|ventilation and oxygenation|lung recruitment maneuver",
    "pulmonary|surgery / incision and drainage of thorax|tracheostomy|planned",
    "surgery|pulmonary therapies|ventilator weaning|rapid",
    "pulmonary|ventilation and oxygenation|prone position",
    "pulmonary|surgery / incision and drainage of thorax|tracheostomy|conventional",
    "pulmonary|ventilation and oxygenation|mechanical ventilation|permissive hypercapnea",
    "surgery|pulmonary therapies|mechanical ventilation|synchronized intermittent",
    "pulmonary|medications|neuromuscular blocking agent",
    "surgery|pulmonary therapies|mechanical ventilation|assist controlled",
    "pulmonary|ventilation and oxygenation|mechanical ventilation|volume assured",
    "surgery|pulmonary therapies|mechanical ventilation|tidal volume 6-10 ml/kg",
    "surgery|pulmonary therapies|mechanical ventilation|pressure support",
    "pulmonary|ventilation and oxygenation|non-invasive ventilation",
    "pulmonary|ventilation and oxygenation|non-invasive ventilation|face mask",
    "pulmonary|ventilation and oxygenation|non-invasive ventilation|nasal mask",
    "pulmonary|ventilation and oxygenation|mechanical ventilation|non-invasive ventilation",
    "pulmonary|ventilation and oxygenation|mechanical ventilation|non-invasive ventilation|face mask",
    "surgery|pulmonary therapies|non-invasive ventilation",
    "surgery|pulmonary therapies|non-invasive ventilation|face mask",
    "pulmonary|ventilation and oxygenation|mechanical ventilation|non-invasive ventilation|nasal mask",
    "surgery|pulmonary therapies|non-invasive ventilation|nasal mask",
    "surgery|pulmonary therapies|mechanical ventilation|non-invasive ventilation",
    "surgery|pulmonary therapies|mechanical ventilation|non-invasive ventilation|face mask",
)

# Treatments that show vasopressor use.
VASOPRESSOR_TREATMENTS = (
    "toxicology|drug overdose|vasopressors|vasopressin",
    "toxicology|drug overdose|vasopressors|phenylephrine (Neosynephrine)",
    "toxicology|drug overdose|vasopressors|norepinephrine > 0.1 micrograms/kg/min",
    "toxicology|drug overdose|vasopressors|norepinephrine <= 0.1 micrograms/kg/min",
    "toxicology|drug overdose|vasopressors|epinephrine > 0.1 micrograms/kg/min",
    "toxicology|drug overdose|vasopressors|epinephrine <= 0.1 micrograms/kg/min",
    "toxicology|drug overdose|vasopressors|dopamine 5-15 micrograms/kg/min",
    "toxicology|drug overdose|vasopressors|dopamine >15 micrograms/kg/min",
    "toxicology|drug overdose|vasopressors",
    "surgery|cardiac therapies|vasopressors|vasopressin",
    "surgery|cardiac therapies|vasopressors|phenylephrine (Neosynephrine)",
    "surgery|cardiac therapies|vasopressors|norepinephrine > 0.1 micrograms/kg/min",
    "surgery|cardiac therapies|vasopressors|norepinephrine <= 0.1 micrograms/kg/min",
    "surgery|cardiac therapies|vasopressors|epinephrine > 0.1 micrograms/kg/min",
    "surgery|cardiac therapies|vasopressors|epinephrine <= 0.1 micrograms/kg/min",
    "surgery|cardiac therapies|vasopressors|dopamine  5-15 micrograms/kg/min",
    "surgery|cardiac therapies|vasopressors|dopamine >15 micrograms/kg/min",
    "surgery|cardiac therapies|vasopressors",
    "renal|electrolyte correction|treatment of hypernatremia|vasopressin",
    "neurologic|therapy for controlling cerebral perfusion pressure|vasopressors|phenylephrine (Neosynephrine)",
    "neurologic|therapy for controlling cerebral perfusion pressure|vasopressors|norepinephrine > 0.1 micrograms/kg/min",
    "neurologic|therapy for controlling cerebral perfusion pressure|vasopressors|norepinephrine <= 0.1 micrograms/kg/min",
    "neurologic|therapy for controlling cerebral perfusion pressure|vasopressors|epinephrine > 0.1 micrograms/kg/min",
    "neurologic|therapy for controlling cerebral perfusion pressure|vasopressors|epinephrine <= 0.1 micrograms/kg/min",
    "neurologic|therapy for controlling cerebral perfusion pressure|vasopressors|dopamine 5-15 micrograms/kg/min",
    "neurologic|therapy for controlling cerebral perfusion pressure|vasopressors|dopamine > 15 micrograms/kg/min",
    "neurologic|therapy for controlling cerebral perfusion pressure|vasopressors",
    "gastrointestinal|medications|hormonal therapy (for varices)|vasopressin",
    "cardiovascular|shock|vasopressors|vasopressin",
    "cardiovascular|shock|vasopressors|phenylephrine (Neosynephrine)",
    "cardiovascular|shock|vasopressors|norepinephrine > 0.1 micrograms/kg/min",
    "cardiovascular|shock|vasopressors|norepinephrine <= 0.1 micrograms/kg/min",
    "cardiovascular|shock|vasopressors|epinephrine > 0.1 micrograms/kg/min",
    "cardiovascular|shock|vasopressors|epinephrine <= 0.1 micrograms/kg/min",
    "cardiovascular|shock|vasopressors|dopamine  5-15 micrograms/kg/min",
    "cardiovascular|shock|vasopressors|dopamine >15 micrograms/kg/min",
    "cardiovascular|shock|vasopressors",
    "toxicology|drug overdose|agent specific therapy|beta blockers overdose|dopamine",
    "cardiovascular|ventricular dysfunction|inotropic agent|norepinephrine > 0.1 micrograms/kg/min",
    "cardiovascular|ventricular dysfunction|inotropic agent|norepinephrine <= 0.1 micrograms/kg/min",
    "cardiovascular|ventricular dysfunction|inotropic agent|epinephrine > 0.1 micrograms/kg/min",
    "cardiovascular|ventricular dysfunction|inotropic agent|epinephrine <= 0.1 micrograms/kg/min",
    "cardiovascular|shock|inotropic agent|norepinephrine > 0.1 micrograms/kg/min",
    "cardiovascular|shock|inotropic agent|norepinephrine <= 0.1 micrograms/kg/min",
    "cardiovascular|shock|inotropic agent|epinephrine > 0.1 micrograms/kg/min",
    "cardiovascular|shock|inotropic agent|epinephrine <= 0.1 micrograms/kg/min",
    "cardiovascular|shock|inotropic agent|dopamine <= 5 micrograms/kg/min",
    "cardiovascular|shock|inotropic agent|dopamine  5-15 micrograms/kg/min",
    "cardiovascular|shock|inotropic agent|dopamine >15 micrograms/kg/min",
    "surgery|cardiac therapies|inotropic agent|dopamine <= 5 micrograms/kg/min",
    "surgery|cardiac therapies|inotropic agent|dopamine  5-15 micrograms/kg/min",
    "surgery|cardiac therapies|inotropic agent|dopamine >15 micrograms/kg/min",
    "cardiovascular|myocardial ischemia / infarction|inotropic agent|norepinephrine > 0.1 micrograms/kg/min",
    "cardiovascular|myocardial ischemia / infarction|inotropic agent|norepinephrine <= 0.1 micrograms/kg/min",
    "cardiovascular|myocardial ischemia / infarction|inotropic agent|epinephrine > 0.1 micrograms/kg/min",
    "cardiovascular|myocardial ischemia / infarction|inotropic agent|epinephrine <= 0.1 micrograms/kg/min",
    "cardiovascular|ventricular dysfunction|inotropic agent|dopamine <= 5 micrograms/kg/min",
    "cardiovascular|ventricular dysfunction|inotropic agent|dopamine  5-15 micrograms/kg/min",
    "cardiovascular|ventricular dysfunction|inotropic agent|dopamine >15 micrograms/kg/min",
    "cardiovascular|myocardial ischemia / infarction|inotropic agent|dopamine <= 5 micrograms/kg/min",
    "cardiovascular|myocardial ischemia / infarction|inotropic agent|dopamine  5-15 micrograms/kg/min",
    "cardiovascular|myocardial ischemia / infarction|inotropic agent|dopamine >15 micrograms/kg/min",
)

# Infusion names per drug.
INFUSION_NAMES = {
    "dopamine": (
        "Dopamine",
        "Dopamine ()",
        "DOPamine MAX 800 mg Dextrose 5% 250 ml  Premix (mcg/kg/min)",
        "Dopamine (mcg/hr)",
        "Dopamine (mcg/kg/hr)",
        "dopamine (mcg/kg/min)",
        "Dopamine (mcg/kg/min)",
        "Dopamine (mcg/min)",
        "Dopamine (mg/hr)",
        "Dopamine (ml/hr)",
        "Dopamine (nanograms/kg/min)",
        "DOPamine STD 15 mg Dextrose 5% 250 ml  Premix (mcg/kg/min)",
        "DOPamine STD 400 mg Dextrose 5% 250 ml  Premix (mcg/kg/min)",
        "DOPamine STD 400 mg Dextrose 5% 500 ml  Premix (mcg/kg/min)",
        "Dopamine (Unknown)",
    ),
    "norepinephrine": (
        "Norepinephrine",
        "Norepinephrine ()",
        "Norepinephrine MAX 32 mg Dextrose 5% 250 ml (mcg/min)",
        "Norepinephrine MAX 32 mg Dextrose 5% 500 ml (mcg/min)",
        "Norepinephrine (mcg/hr)",
        "Norepinephrine (mcg/kg/hr)",
        "Norepinephrine (mcg/kg/min)",
        "Norepinephrine (mcg/min)",
        "Norepinephrine (mg/hr)",
        "Norepinephrine (mg/kg/min)",
        "Norepinephrine (mg/min)",
        "Norepinephrine (ml/hr)",
        "Norepinephrine STD 32 mg Dextrose 5% 282 ml (mcg/min)",
        "Norepinephrine STD 32 mg Dextrose 5% 500 ml (mcg/min)",
        "Norepinephrine STD 4 mg Dextrose 5% 250 ml (mcg/min)",
        "Norepinephrine STD 4 mg Dextrose 5% 500 ml (mcg/min)",
        "Norepinephrine STD 8 mg Dextrose 5% 250 ml (mcg/min)",
        "Norepinephrine STD 8 mg Dextrose 5% 500 ml (mcg/min)",
        "Norepinephrine (units/min)",
        "Norepinephrine (Unknown)",
        "norepinephrine Volume (ml)",
        "norepinephrine Volume (ml) (ml/hr)",
        "Levophed (mcg/kg/min)",
        "levophed  (mcg/min)",
        "levophed (mcg/min)",
        "Levophed (mcg/min)",
        "Levophed (mg/hr)",
        "levophed (ml/hr)",
        "Levophed (ml/hr)",
        "NSS with LEVO (ml/hr)",
        "NSS w/ levo/vaso (ml/hr)",
    ),
    "phenylephrine": (
        "Phenylephrine",
        "Phenylephrine ()",
        "Phenylephrine  MAX 100 mg Sodium Chloride 0.9% 250 ml (mcg/min)",
        "Phenylephrine (mcg/hr)",
        "Phenylephrine (mcg/kg/min)",
        "Phenylephrine (mcg/kg/min) (mcg/kg/min)",
        "Phenylephrine (mcg/min)",
        "Phenylephrine (mcg/min) (mcg/min)",
        "Phenylephrine (mg/hr)",
        "Phenylephrine (mg/kg/min)",
        "Phenylephrine (ml/hr)",
        "Phenylephrine  STD 20 mg Sodium Chloride 0.9% 250 ml (mcg/min)",
        "Phenylephrine  STD 20 mg Sodium Chloride 0.9% 500 ml (mcg/min)",
        "Volume (ml) Phenylephrine",
        "Volume (ml) Phenylephrine ()",
        "neo-synephrine (mcg/min)",
        "neosynephrine (mcg/min)",
        "Neosynephrine (mcg/min)",
        "Neo Synephrine (mcg/min)",
        "Neo-Synephrine (mcg/min)",
        "NeoSynephrine (mcg/min)",
        "NEO-SYNEPHRINE (mcg/min)",
        "Neosynephrine (ml/hr)",
        "neosynsprine",
        "neosynsprine (mcg/kg/hr)",
    ),
    "epinephrine": (
        "EPI (mcg/min)",
        "Epinepherine (mcg/min)",
        "Epinephrine",
        "Epinephrine ()",
        "EPINEPHrine(Adrenalin)MAX 30 mg Sodium Chloride 0.9% 250 ml (mcg/min)",
        "EPINEPHrine(Adrenalin)STD 4 mg Sodium Chloride 0.9% 250 ml (mcg/min)",
        "EPINEPHrine(Adrenalin)STD 4 mg Sodium Chloride 0.9% 500 ml (mcg/min)",
        "EPINEPHrine(Adrenalin)STD 7 mg Sodium Chloride 0.9% 250 ml (mcg/min)",
        "Epinephrine (mcg/hr)",
        "Epinephrine (mcg/kg/min)",
        "Epinephrine (mcg/min)",
        "Epinephrine (mg/hr)",
        "Epinephrine (mg/kg/min)",
        "Epinephrine (ml/hr)",
    ),
    "vasopressin": (
        "Vasopressin",
        "Vasopressin ()",
        "Vasopressin 20 Units Sodium Chloride 0.9% 100 ml (units/hr)",
        "Vasopressin 20 Units Sodium Chloride 0.9% 250 ml (units/hr)",
        "Vasopressin 40 Units Sodium Chloride 0.9% 100 ml (units/hr)",
        "Vasopressin 40 Units Sodium Chloride 0.9% 100 ml (units/kg/hr)",
        "Vasopressin 40 Units Sodium Chloride 0.9% 100 ml (units/min)",
        "Vasopressin 40 Units Sodium Chloride 0.9% 100 ml (Unknown)",
        "Vasopressin 40 Units Sodium Chloride 0.9% 200 ml (units/min)",
        "Vasopressin (mcg/kg/min)",
        "Vasopressin (mcg/min)",
        "Vasopressin (mg/hr)",
        "Vasopressin (mg/min)",
        "vasopressin (ml/hr)",
        "Vasopressin (ml/hr)",
        "Vasopressin (units/hr)",
        "Vasopressin (units/kg/min)",
        "vasopressin (units/min)",
        "Vasopressin (units/min)",
        "VAsopressin (units/min)",
        "Vasopressin (Unknown)",
    ),
    "milrinone": (
        "Milrinone",
        "Milrinone ()",
        "Milrinone (mcg/kg/hr)",
        "Milrinone (mcg/kg/min)",
        "Milrinone (ml/hr)",
        "Milrinone (Primacor) 40 mg Dextrose 5% 200 ml (mcg/kg/min)",
        "Milronone (mcg/kg/min)",
        "primacore (mcg/kg/min)",
    ),
    "heparin": (
        "Hepain (ml/hr)",
        "Heparin",
        "Heparin ()",
        "Heparin 25,000 Unit/D5w 250 ml (ml/hr)",
        "Heparin 25000 Units Dextrose 5% 500 ml  Premix (units/hr)",
        "Heparin 25000 Units Dextrose 5% 500 ml  Premix (units/kg/hr)",
        "Heparin 25000 Units Dextrose 5% 950 ml  Premix (units/kg/hr)",
        "HEPARIN #2 (units/hr)",
        "Heparin 8000u/1L NS (ml/hr)",
        "Heparin-EKOS (units/hr)",
        "Heparin/Femoral Sheath   (units/hr)",
        "Heparin (mcg/kg/hr)",
        "Heparin (mcg/kg/min)",
        "Heparin (ml/hr)",
        "heparin (units/hr)",
        "Heparin (units/hr)",
        "HEPARIN (units/hr)",
        "Heparin (units/kg/hr)",
        "Heparin (Unknown)",
        "Heparin via sheath (units/hr)",
        "Left  Heparin (units/hr)",
        "NSS carrier heparin (ml/hr)",
        "S-Heparin (units/hr)",
        "Volume (ml) Heparin-heparin 25,000 units in 0.45 % sodium chloride 500 mL infusion",
        "Volume (ml) Heparin-heparin 25,000 units in 0.45 % sodium chloride 500 mL infusion (ml/hr)",
        "Volume (ml) Heparin-heparin 25,000 units in dextrose 500 mL infusion",
        "Volume (ml) Heparin-heparin 25,000 units in dextrose 500 mL infusion (ml/hr)",
        "Volume (ml) Heparin-heparin infusion 2 units/mL in 0.9% sodium chloride (ARTERIAL LINE)",
        "Volume (ml) Heparin-heparin infusion 2 units/mL in 0.9% sodium chloride (ARTERIAL LINE) (ml/hr)",
    ),
}
# Fixed value: dobutamine is recognised by a pattern on the lower-cased name.
DOBUTAMINE_PATTERN = "%dobu%"
INFUSION_DRUGS = (
    "dopamine",
    "dobutamine",
    "norepinephrine",
    "phenylephrine",
    "epinephrine",
    "vasopressin",
    "milrinone",
    "heparin",
)

# Ordered-drug codes, then lower-cased name patterns used where the code is missing.
ORDER_CODES = {
    "norepinephrine": (37410, 36346, 2051),
    "epinephrine": (37407, 39089, 36437, 34361, 2050),
    "dobutamine": (8777, 40),
    "dopamine": (2060, 2059),
    "phenylephrine": (37028, 35517, 35587, 2087),
    "vasopressin": (38884, 38883, 2839),
    "milrinone": (9744,),
    "heparin": (39654, 9545, 2807, 33442, 8643, 33314, 2808, 2810),
    "warfarin": (2812, 24859),
}
ORDER_NAMES = (
    ("%heparin%", "heparin"),
    ("%warfarin%", "warfarin"),
    ("%coumadin%", "warfarin"),
    ("%dobutamine%", "dobutamine"),
    ("%dobutrex%", "dobutamine"),
    ("%norepinephrine%", "norepinephrine"),
    ("%levophed%", "norepinephrine"),
    ("epinephrine%", "epinephrine"),
    ("%phenylephrine%", "phenylephrine"),
    ("%neosynephrine%", "phenylephrine"),
    ("%vasopressin%", "vasopressin"),
    ("%milrinone%", "milrinone"),
)
ORDER_DRUGS = (
    "norepinephrine",
    "epinephrine",
    "dopamine",
    "dobutamine",
    "phenylephrine",
    "vasopressin",
    "milrinone",
    "heparin",
    "warfarin",
)
# The drugs whose order counts as vasopressor time.
VASOPRESSORS = ("norepinephrine", "epinephrine", "dopamine", "phenylephrine", "vasopressin")

# Renal replacement words; together with "chronic" they exclude a stay.
RENAL_REPLACEMENT_PATTERNS = ("%rrt%", "%dialysis%", "%ultrafiltration%", "%cavhd%", "%cvvh%", "%sled%")

# Diagnosis code fragments (offset source).
HISTORY_FRAGMENTS = {
    "hypertension": "I10",
    "atrial_fibrillation": "I48",
    "cancer": "C80",
    "chf": "I50",
    "ckd": "N18",
    "cld": "K74",
    "copd": "J44",
    "diabetes": "E11",
    "ihd": "I25",
    "cebrovascular_accident": "I63",
}

# Diagnosis code prefixes and lists (timestamp source).
COMORBID_PREFIXES = {
    "afib": ("4273",),
    "cld": ("571",),
    "cereb": ("433", "434", "435", "436", "437"),
    "ihd": ("410", "411", "412", "413"),
}
COMORBID_CODES = {
    "ckd": ("5854", "5855", "5856"),
    "copd": (
        "4660",
        "490",
        "4910",
        "4911",
        "49120",
        "49121",
        "4918",
        "4919",
        "4920",
        "4928",
        "494",
        "4940",
        "4941",
        "496",
    ),
}
# Three-digit groups 140-172, 174-209 and 230-239.
CANCER_GROUPS = tuple(str(g) for g in (*range(140, 173), *range(174, 210), *range(230, 240)))

# Item codes of charted vitals with the open plausible range of each series.
VITAL_ITEMS = {
    "heartrate": ((211, 220045), 0, 300),
    "sysbp": ((51, 6701, 220050), 0, 400),
    "diasbp": ((8368, 8555, 220051), 0, 300),
    "meanbp": ((52, 6702, 220052, 225312), 0, 300),
    "resprate": ((615, 618, 220210, 224690), 0, 70),
    "glucose": ((807, 811, 1529, 3745, 3744, 225664, 220621, 226537), 0, None),
}
TEMP_F_ITEMS, TEMP_F_RANGE = (223761, 678), (70, 120)
TEMP_C_ITEMS, TEMP_C_RANGE = (223762, 676), (10, 50)
SPO2_ITEMS, SPO2_RANGE = (646, 220277), (0, 100)  # upper end included

# Pressure series and ranges that qualify a stay for the cohort.
COHORT_ITEMS = {
    "sbp": ((51, 6701, 220050), 0, 300),
    "dbp": ((8368, 8555, 220051), 0, 200),
    "mbp": ((52, 6702, 220052, 225312), 0, 250),
}

# Height items.
HEIGHT_INCH_ITEMS = (920, 1394, 4187, 3486, 226707)
HEIGHT_CM_ITEMS = (3485, 4188)
CREATININE_ITEM = 50912

# Fluid items of the two charting systems.
FLUID_ITEMS_BOLUS = (
    30058, 30065, 30013, 30187, 30016, 30317, 30318, 30018, 30296, 30190,
    30021, 30020, 30160, 30159, 30143, 30061, 30015, 30060, 30030, 30008,
    30032, 30196, 30096, 30197, 30198, 30199, 30200, 30325, 30194, 30313,
    30301, 30191, 30193, 30192, 30323, 30314, 30203, 30099, 30208,
)
FLUID_ITEMS_RATE = (
    225944, 220949, 220952, 220950, 225158, 225943, 226089, 225828, 227533, 225159,
    225823, 225825, 225827, 225941, 225161, 220995, 220862, 220864, 225916, 225917,
    225948, 225947, 225920, 225969,
)

# Ethnicity prefixes, first match wins.
ETHNICITY_PREFIXES = ("ASIAN", "WHITE", "HISPANIC", "BLACK")
ETHNICITY_OTHER = "OTHERS"

# Bands of the time-in-range tables, per pressure series.
PRESSURE_BANDS = {
    "map": ("ibp_mean", 70, 80),
    "asp": ("ibp_systolic", 110, 120),
    "adp": ("ibp_diastolic", 50, 60),
}
HORIZONS_HOURS = (24, 48, 72)

# Admission diagnosis texts of each group; any other text is OTHER_DIAGNOSIS.
DIAGNOSIS_GROUPS = {
    "ACS": (
        "Angina, unstable (angina interferes w/quality of life or meds are tolerated poorly)",
        "Infarction, acute myocardial (MI)",
        "MI admitted > 24 hrs after onset of ischemia",
    ),
    "ChestPainUnknown": (
        "Chest pain, atypical (noncardiac chest pain)",
        "Chest pain, epigastric",
        "Chest pain, musculoskeletal",
        "Chest pain, respiratory",
        "Chest pain, unknown origin",
    ),
    "CHF": (
        "Cardiomyopathy",
        "CHF, congestive heart failure",
        "Shock, cardiogenic",
    ),
    "CVOther": (
        "Angina, stable (asymp or stable pattern of symptoms w/meds)",
        "Anomaly, cardiac congenital",
        "Arteriovenous malformation, surgery for",
        "Atrial Septal Defect (ASD) Repair",
        "Cardiovascular medical, other",
        "Cardiovascular surgery, other",
        "Congenital Defect Repair (Other)",
        "Contusion, myocardial (include r/o)",
        "Efffusion, pericardial",
        "Endocarditis",
        "Hypertension-pulmonary, primary/idiopathic",
        "Monitoring, hemodynamic (pre-operative evaluation)",
        "Pericardial effusion/tamponade",
        "Pericardiectomy (total/subtotal)",
        "Pericarditis",
        "Tamponade, pericardial",
        "Thrombus, arterial",
        "Vascular medical, other",
        "Vascular surgery, other",
        "Ablation or mapping of cardiac conduction pathway",
        "Defibrillator, automatic implantable cardiac; insertion of",
    ),
    "CardiacArrest": (
        "Cardiac arrest (with or without respiratory arrest; for respiratory arrest see Respiratory System)",
        "Rhythm disturbance (atrial, supraventricular)",
        "Rhythm disturbance (conduction defect)",
        "Rhythm disturbance (ventricular)",
    ),
    "CABG": (
        "CABG alone, coronary artery bypass grafting",
        "CABG alone, redo",
        "CABG redo with other operation",
        "CABG redo with valve repair/replacement",
        "CABG with aortic valve replacement",
        "CABG with double valve repair/replacement",
        "CABG with mitral valve repair",
        "CABG with mitral valve replacement",
        "CABG with other operation",
        "CABG with pulmonic or tricuspid valve repair or replacement ONLY.",
        "CABG with single valve repair/replacement",
        "CABG, minimally invasive; mid-CABG",
    ),
    "ValveDz": (
        "Aortic and Mitral valve replacement",
        "Aortic valve replacement (isolated)",
        "Mitral valve repair",
        "Mitral valve replacement",
        "Papillary muscle rupture",
        "Pulmonary valve surgery",
        "Tricuspid valve surgery",
        "Valve, double; repair/replacement",
        "Valve, redo, single",
        "Valve, single; repair/replacement",
        "Valve, triple; repair/replacement",
    ),
    "PNA": (
        "Pneumonia, aspiration",
        "Pneumonia, bacterial",
        "Pneumonia, fungal",
        "Pneumonia, other",
        "Pneumonia, parasitic (i.e., Pneumocystic pneumonia)",
        "Pneumonia, viral",
    ),
    "RespMedOther": (
        "Apnea, sleep",
        "Apnea-sleep; surgery for (i.e., UPPP - uvulopalatopharyngoplasty)",
        "ARDS-adult respiratory distress syndrome, non-cardiogenic pulmonary edema",
        "Arrest, respiratory (without cardiac arrest)",
        "Atelectasis",
        "Biopsy, open lung",
        "Effusions, pleural",
        "Embolus, pulmonary",
        "Guillain-Barre syndrome",
        "Hemorrhage/hemoptysis, pulmonary",
        "Hemothorax",
        "Obstruction-airway (i.e., acute epiglottitis, post-extubation edema, foreign body, etc)",
        "Pneumothorax",
        "Respiratory - medical, other",
        "Restrictive lung disease (i.e., Sarcoidosis, pulmonary fibrosis)",
        "Tracheostomy",
        "Weaning from mechanical ventilation (transfer from other unit or hospital only)",
    ),
    "Asthma-Emphys": (
        "Asthma",
        "Emphysema/bronchitis",
    ),
    "GIBleed": (
        "Bleeding, GI from esophageal varices/portal hypertension",
        "Bleeding, GI-location unknown",
        "Bleeding, lower GI",
        "Bleeding, upper GI",
        "Bleeding-lower GI, surgery for",
        "Bleeding-other GI, surgery for",
        "Bleeding-upper GI, surgery for",
        "Bleeding-variceal, surgery for (excluding vascular shunting-see surgery for portosystemic shunt)",
        "GI perforation/rupture",
        "GI perforation/rupture, surgery for",
        "Hemorrhage, intra/retroperitoneal",
        "Ulcer disease, peptic",
    ),
    "GIObstruction": (
        "GI obstruction",
        "GI obstruction, surgery for (including lysis of adhesions)",
    ),
    "CVA": (
        "CVA, cerebrovascular accident/stroke",
        "Hemorrhage/hematoma, intracranial",
        "Hemorrhage/hematoma-intracranial, surgery for",
        "Hypertension, uncontrolled (for cerebrovascular accident-see Neurological System)",
        "Subarachnoid hemorrhage/arteriovenous malformation",
        "Subarachnoid hemorrhage/intracranial aneurysm",
        "Subarachnoid hemorrhage/intracranial aneurysm, surgery for",
    ),
    "Neuro": (
        "Abscess, neurologic",
        "Biopsy, brain",
        "Hydrocephalus, obstructive",
        "Neoplasm, neurologic",
        "Neoplasm-cranial, surgery for (excluding transphenoidal)",
        "Neoplasm-spinal cord, surgery or other related procedures",
        "Neurologic medical, other",
        "Neuromuscular medical, other",
        "Palsy, cranial nerve",
        "Seizures (primary-no structural brain disease)",
        "Seizures-intractable, surgery for",
    ),
    "Coma": (
        "Coma/change in level of consciousness (for hepatic see GI, for diabetic see Endocrine, if related to cardiac arrest, see CV)",
        "Nontraumatic coma due to anoxia/ischemia",
    ),
    "Overdose": (
        "Overdose, alcohols (bethanol, methanol, ethylene glycol)",
        "Overdose, analgesic (aspirin, acetaminophen)",
        "Overdose, antidepressants (cyclic, lithium)",
        "Overdose, other toxin, poison or drug",
        "Overdose, sedatives, hypnotics, antipsychotics, benzodiazepines",
        "Overdose, self-inflicted",
        "Overdose, street drugs (opiates, cocaine, amphetamine)",
        "Toxicity, drug (i.e., beta blockers, calcium channel blockers, etc.)",
    ),
    "Sepsis": (
        "Sepsis, cutaneous/soft tissue",
        "Sepsis, GI",
        "Sepsis, gynecologic",
        "Sepsis, other",
        "Sepsis, pulmonary",
        "Sepsis, renal/UTI (including bladder)",
        "Sepsis, unknown",
    ),
    "ARF": (
        "Renal failure, acute",
        "Renal obstruction",
    ),
    "DKA": (
        "Diabetic hyperglycemic hyperosmolar nonketotic coma (HHNC)",
        "Diabetic ketoacidosis",
    ),
    "Trauma": (
        "Abdomen only trauma",
        "Abdomen/extremity trauma",
        "Abdomen/face trauma",
        "Abdomen/multiple trauma",
        "Abdomen/pelvis trauma",
        "Abdomen/spinal trauma",
        "Chest thorax only trauma",
        "Chest/abdomen trauma",
        "Chest/extremity trauma",
        "Chest/face trauma",
        "Chest/multiple trauma",
        "Chest/pelvis trauma",
        "Chest/spinal trauma",
        "Chest/thorax only trauma",
        "Extremity only trauma",
        "Extremity only trauma, surgery for",
        "Extremity/face trauma",
        "Extremity/face trauma, surgery for",
        "Extremity/multiple trauma",
        "Extremity/multiple trauma, surgery for",
        "Face only trauma",
        "Face only trauma, surgery for",
        "Face/multiple trauma",
        "Face/multiple trauma, surgery for",
        "Facial surgery (if related to trauma, see Trauma)",
        "Head only trauma",
        "Head/abdomen trauma",
        "Head/chest trauma",
        "Head/extremity trauma",
        "Head/face trauma",
        "Head/multiple trauma",
        "Head/pelvis trauma",
        "Head/spinal trauma",
        "Pelvis/extremity trauma",
        "Pelvis/face trauma",
        "Pelvis/hip trauma",
        "Pelvis/multiple trauma",
        "Pelvis/spinal trauma",
        "Spinal cord only trauma",
        "Spinal/extremity trauma",
        "Spinal/face trauma",
        "Spinal/multiple trauma",
        "Trauma medical, other",
        "Trauma surgery, other",
    ),
}
OTHER_DIAGNOSIS = "Other"
