"""The classification rules in DuckDB SQL, written out by hand from their statement: no table of an operator is read here, so a
wrong limit on either side shows. Sizes in mm; s1, s2, s3 are the sorted extents, rz is the height above the floor (0 here)."""

SIZED = """sz AS (SELECT *, list_sort([max_x - min_x, max_y - min_y, max_z - min_z]) AS ss, max_x - min_x AS w, max_y - min_y AS d, max_z - min_z AS h FROM segments_v),
m AS (SELECT * EXCLUDE (ss), ss[1] AS min_e, ss[2] AS mid_e, ss[3] AS max_e, 0.0E0 AS datum, cz AS rz, (ss[1] + ss[2]) / 2 AS dia, h > w AND h > d AS up FROM sz)"""

VIABLE = """CASE WHEN max_e < 50 THEN 'major_span_lt_50mm' WHEN shape = 'void' THEN NULL WHEN point_count = 0 THEN 'non_void_zero_points' WHEN mid_e < 20 THEN 'mid_span_lt_20mm' WHEN min_e < 3 THEN 'minor_span_lt_3mm' END"""

VALID = """CASE WHEN isnan(min_x + max_x + min_y + max_y + min_z + max_z) THEN 'not_a_number' WHEN w < 0 OR d < 0 OR h < 0 THEN 'inverted_box' WHEN max_e < 10 THEN 'degenerate_box'
 WHEN NOT (cx BETWEEN min_x - 1 AND max_x + 1 AND cy BETWEEN min_y - 1 AND max_y + 1 AND cz BETWEEN min_z - 1 AND max_z + 1) THEN 'centroid_outside' END"""

FOUND = """ty AS (SELECT *, max_e / greatest(dia, 1) AS ar, max_e / greatest(mid_e, 1) AS f, min_e / greatest(mid_e, 1) AS flat, greatest(w, d) AS wide, least(w, d) AS narrow FROM m),
ex AS (SELECT *, up AND cz BETWEEN 700 AND 1800 AND min_e > 90 AND min_e < 300 AND mid_e < 380 AND max_e > 300 AND max_e < 1100 AS bottle,
  max_e >= 2500 AND f >= 5 AND mid_e / greatest(min_e, 1) <= 1.8 AND min_e <= 250 AND mid_e <= 450 AND mid_e / greatest(max_e, 1) <= 0.25 AS pipelike FROM ty),
tr AS (SELECT *, max_e >= 1200 AND NOT up AND min_e <= 320 AND mid_e <= 700 AND wide >= 2 * greatest(h, 1) AND rz BETWEEN 800 AND 4500 AND h >= 120 AND wide >= 240 AND h <= 0.65 * wide AND NOT pipelike AND flat < 0.75
  AND (f >= 2.2)::INT + (flat BETWEEN 0.20 AND 0.60)::INT + 0.75 + 0.5 * (wide / greatest(h, 1) >= 2.2)::INT + 0.5 * (rz < 3500)::INT + 0.25 * (f >= 1.8)::INT + 0.25 * (point_count >= 24)::INT >= 2.5 AS tray FROM ex),
fd AS (SELECT *, CASE WHEN point_count <= 0 AND shape <> 'void' THEN 'unknown' WHEN max_e < 50 THEN 'unknown'
 WHEN shape = 'valve_candidate' THEN CASE WHEN max_e < 160 AND mid_e < 100 AND up THEN 'safety_relief_valve' WHEN max_e < 200 AND h <= w THEN 'expansion_joint' WHEN min_e < 120 AND mid_e < 200 AND max_e < 320 THEN 'strainer' WHEN max_e > 450 THEN 'deluge_valve' ELSE 'valve' END
 WHEN shape = 'plane_vertical' THEN CASE WHEN h > 80 AND h < 600 THEN 'bund_wall' WHEN wide < 800 AND wide / least(narrow, 1.0) < 3 THEN 'column' ELSE 'wall' END
 WHEN shape = 'plane_horizontal' THEN CASE WHEN w * d > 250000 AND point_count / greatest(w * d / 1000000, 0.01) < 20 THEN 'grating' WHEN rz > 1800 THEN 'ceiling' ELSE 'floor' END
 WHEN shape = 'plane_sloped' THEN CASE WHEN h >= 700 AND h / greatest(wide, 1) >= 0.35 THEN 'stair' ELSE 'ramp' END
 WHEN shape = 'void' THEN CASE WHEN h < 400 AND w * d > 90000 THEN CASE WHEN wide / greatest(narrow, 1) > 5 THEN 'trench' WHEN w * d < 600000 THEN 'hatch' WHEN point_count = 0 THEN 'unknown' ELSE 'slab_opening' END WHEN min_z < 300 THEN 'door' ELSE 'window' END
 WHEN shape = 'cylinder' THEN CASE WHEN dia > 1500 AND max_e > 10000 THEN 'steam_generator' WHEN dia > 400 AND dia < 1600 AND ar > 7 AND max_e > 5000 THEN 'pressurizer' WHEN dia > 200 AND dia < 1500 AND ar > 3 AND ar <= 7 AND max_e > 1000 THEN 'heat_exchanger'
  WHEN dia > 300 AND dia < 2500 AND ar BETWEEN 1 AND 3 AND max_e > 1000 THEN CASE WHEN w * d * h > 1e9 THEN 'pressure_vessel' ELSE 'tank' END WHEN dia > 250 AND max_e < 150 AND rz < 500 THEN 'seismic_isolator'
  WHEN dia BETWEEN 80 AND 250 AND max_e BETWEEN 300 AND 900 AND rz BETWEEN 700 AND 1800 THEN 'fire_extinguisher' WHEN max_e >= 120 AND ar >= 1.6 AND dia BETWEEN 30 AND 500 THEN 'pipe'
  WHEN max_e < 180 THEN CASE WHEN rz > 2400 AND max_e < 80 THEN 'smoke_detector' WHEN rz > 600 AND rz < 900 AND dia > 40 THEN 'fire_hydrant' WHEN rz > 2200 THEN 'sprinkler' WHEN rz < 200 AND ar < 1.8 THEN 'drainage' ELSE 'valve' END
  WHEN dia > 1200 THEN 'tank' WHEN dia < 60 THEN 'conduit' ELSE 'pipe' END
 WHEN shape = 'box' THEN CASE WHEN pipelike THEN 'pipe' WHEN point_count < 12 AND max_e < 500 AND NOT bottle THEN 'unknown' WHEN tray THEN 'cable_tray' WHEN rz > 4000 AND max_e > 5000 AND NOT up THEN 'overhead_crane'
  WHEN min_e > 800 AND mid_e > 1000 AND max_e > 3000 THEN 'emergency_diesel_generator' WHEN min_e > 500 AND mid_e > 600 AND max_e > 800 AND max_e < 4000 AND rz < 2500 THEN 'transformer' WHEN min_e > 350 AND mid_e > 450 AND max_e > 1500 AND rz < 1500 THEN 'compressor'
  WHEN min_e < 700 AND mid_e > 400 AND max_e > 1500 AND rz BETWEEN 800 AND 2000 THEN 'switchgear' WHEN min_e > 200 AND mid_e > 200 AND min_e < 700 AND mid_e < 700 AND max_e > 2000 AND rz < 1200 THEN 'ups_system'
  WHEN up AND h > 2000 AND min_e < 600 AND mid_e < 600 THEN 'ladder' WHEN bottle THEN 'fire_extinguisher'
  WHEN max_e > 700 AND f > 3 AND min_e < 220 THEN CASE WHEN mid_e <= 120 THEN 'conduit' WHEN rz > 2400 AND min_e < 180 AND mid_e < 280 THEN 'lighting_fitting' ELSE 'beam' END
  WHEN min_e < 120 AND mid_e < 220 AND max_e > 80 AND max_e < 420 AND rz > 800 AND rz < 2600 AND f < 2.2 AND point_count >= 20 THEN 'radiation_monitor' WHEN min_e < 100 AND mid_e > 150 AND mid_e < 600 AND max_e < 700 AND rz > 1000 AND rz < 2200 THEN 'fire_alarm_panel'
  WHEN min_e < 100 AND mid_e < 300 AND max_e < 300 THEN 'junction_box' WHEN min_e < 120 AND max_e > 250 AND max_e < 1000 AND f > 2.5 AND rz > 500 AND rz < 3500 THEN 'pipe_support' WHEN rz > 2200 AND min_e < 200 AND max_e > 200 AND max_e < 2000 THEN 'lighting_fitting'
  WHEN rz < 150 AND max_e > 350 AND max_e < 1400 AND NOT up THEN 'kerb' WHEN rz < 150 AND min_e < 220 AND f < 2.2 AND max_e < 600 THEN 'drainage' WHEN rz BETWEEN 800 AND 1200 AND min_e < 200 THEN 'railing'
  WHEN min_e < 250 AND mid_e > 400 AND f < 3 AND rz BETWEEN 1000 AND 2000 THEN 'electrical_panel' WHEN f >= 2.5 AND NOT up AND rz > 1800 THEN 'beam' WHEN min_e > 400 AND mid_e > 400 THEN CASE WHEN rz < 1000 THEN 'pump' ELSE 'hvac_equipment' END ELSE 'generic_model' END
 ELSE 'unknown' END AS found FROM tr)"""

CLASSIFIED = f"""{SIZED}, {FOUND},
t AS (SELECT *, CASE found WHEN 'bund_wall' THEN 'wall' WHEN 'hatch' THEN 'slab_opening' WHEN 'trench' THEN 'slab_opening' ELSE found END AS element_type FROM fd),
c AS (SELECT *, CASE
  WHEN element_type IN ('ceiling', 'stair', 'ramp', 'door', 'window', 'railing', 'ladder', 'grating') THEN 'architectural'
  WHEN element_type IN ('trench', 'kerb') THEN 'civil'
  WHEN element_type IN ('sprinkler', 'fire_hydrant', 'fire_extinguisher', 'deluge_valve', 'fire_alarm_panel', 'smoke_detector', 'fire_damper') THEN 'fire_protection'
  WHEN element_type IN ('wall', 'floor', 'column', 'beam', 'overhead_crane', 'seismic_isolator', 'slab_opening', 'unknown', 'generic_model') THEN 'structural' ELSE 'mep' END AS discipline,
 CASE WHEN element_type = 'wall' THEN CASE WHEN h > 3500 AND w > 8000 AND point_count * 1000000 >= 5 * w * h THEN 'SC1' WHEN h > 3200 AND point_count > 3000 THEN 'SC3' ELSE 'NS' END
  WHEN element_type = 'beam' OR (element_type = 'column' AND h > 3000) THEN CASE WHEN confidence < 0.75 THEN 'SC2' ELSE 'NS' END
  WHEN element_type IN ('steam_generator', 'pressurizer', 'emergency_diesel_generator', 'safety_relief_valve') THEN 'SC1'
  WHEN element_type IN ('door', 'valve', 'sprinkler', 'slab_opening', 'pressure_vessel', 'heat_exchanger', 'transformer', 'ups_system', 'fire_hydrant', 'deluge_valve', 'fire_alarm_panel', 'overhead_crane', 'compressor', 'seismic_isolator', 'radiation_monitor') THEN 'SC2'
  WHEN element_type IN ('railing', 'stair', 'tank', 'hvac_equipment', 'pump', 'duct', 'pipe', 'electrical_panel', 'switchgear', 'strainer', 'expansion_joint', 'fire_extinguisher', 'smoke_detector') THEN 'SC3' ELSE 'NS' END AS safety_category,
 CASE element_type WHEN 'tank' THEN 'Zone2' WHEN 'pipe' THEN 'Zone2' WHEN 'valve' THEN 'Zone1' WHEN 'pressure_vessel' THEN 'Zone1' WHEN 'heat_exchanger' THEN 'Zone1' WHEN 'compressor' THEN 'Zone1' ELSE 'none' END AS dsear_zone FROM t)"""

TAXONOMY = "CASE shape WHEN 'plane_vertical' THEN 'WALL' WHEN 'plane_horizontal' THEN 'FLOOR' WHEN 'plane_sloped' THEN 'STAIR' WHEN 'cylinder' THEN 'PIPE' WHEN 'void' THEN 'OPENING' ELSE 'UNSUPPORTED' END"

WANTED = "('pipe', 'diameter'), ('pipe', 'length'), ('pipe', 'material'), ('valve', 'diameter'), ('valve', 'type'), ('valve', 'rating'), ('pump', 'flow'), ('pump', 'head'), ('pump', 'power'), ('tank', 'volume'), ('tank', 'material')"

PLANE_CLASS = """CASE WHEN curvature >= 0.55 OR (curvature >= 0.35 AND centre_m < 1.6 AND height_m >= 4.0) THEN 'curved_structural_surface' WHEN score >= 0.52 AND aligned AND height_m >= 1.8 AND length_m >= 1.5 AND curvature < 0.35 THEN 'architectural_wall'
 WHEN score >= 0.38 AND aligned AND height_m >= 0.4 AND length_m >= 0.3 AND curvature < 0.4 THEN 'wall_fragment' WHEN centre_m < 1.3 AND (fill < 0.32 OR density < 30 OR NOT aligned) THEN 'mep_equipment' WHEN length_m < 2 AND (fill < 0.2 OR density < 18) THEN 'mep_equipment'
 WHEN height_m < 1 AND length_m < 1 THEN 'furniture_object' WHEN length_m < 0.8 AND height_m >= 2 THEN 'structural_nonwall' WHEN NOT aligned AND centre_m < 2 THEN 'mep_equipment' ELSE 'other' END"""

ALLOWED = """((a.element_type IN ('valve', 'safety_relief_valve', 'strainer', 'expansion_joint', 'fire_damper', 'deluge_valve', 'pipe_support') AND b.element_type IN ('pipe', 'conduit', 'duct', 'cable_tray'))
 OR (b.element_type IN ('valve', 'safety_relief_valve', 'strainer', 'expansion_joint', 'fire_damper', 'deluge_valve', 'pipe_support') AND a.element_type IN ('pipe', 'conduit', 'duct', 'cable_tray'))
 OR (a.element_type = 'conduit' AND b.element_type IN ('wall', 'floor', 'ceiling', 'grating', 'slab_opening')) OR (b.element_type = 'conduit' AND a.element_type IN ('wall', 'floor', 'ceiling', 'grating', 'slab_opening'))
 OR (a.element_type IN ('floor', 'ceiling', 'grating') AND b.element_type IN ('floor', 'ceiling', 'grating') AND greatest(a.min_z, b.min_z) >= least(a.max_z, b.max_z)))"""
