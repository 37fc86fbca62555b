"""Rows that the queries over the sample patents and claims must give, written out as SQL."""

# fmt: off
CLAIM_LINKS = r"""SELECT * FROM (VALUES
('case', CAST(1 AS INTEGER), CAST(1 AS INTEGER), 'Изделие', 'N', 'N0', 'self', CAST(0 AS INTEGER), NULL, NULL),
('case', CAST(2 AS INTEGER), CAST(1 AS INTEGER), 'содержащее корпус', 'V_N', 'V<P>_N0', 'sub', CAST(1 AS INTEGER), '1', '1'),
('case', CAST(3 AS INTEGER), CAST(1 AS INTEGER), 'выполненный в виде цилиндра', 'V_N', 'V<P>_N', 'sub', CAST(2 AS INTEGER), '2', '1'),
('case', CAST(4 AS INTEGER), CAST(1 AS INTEGER), 'в котором размещены плата', 'который_V_N', 'который_V<F>_N0', 'spec', CAST(2 AS INTEGER), '2', '2'),
('case', CAST(5 AS INTEGER), CAST(1 AS INTEGER), 'блоки питания', 'N', 'N0', 'homo', CAST(4 AS INTEGER), '3', '1'),
('case', CAST(6 AS INTEGER), CAST(2 AS INTEGER), 'блок подключен к насосу', 'N_V_N', 'N0_V<F>_N', 'self', CAST(0 AS INTEGER), NULL, NULL),
('device', CAST(1 AS INTEGER), CAST(0 AS INTEGER), 'Прибор', 'N', 'N0', 'self', CAST(0 AS INTEGER), NULL, NULL),
('device', CAST(2 AS INTEGER), CAST(0 AS INTEGER), 'содержащий блок', 'V_N', 'V<P>_N0', 'sub', CAST(1 AS INTEGER), '1', '1'),
('device', CAST(3 AS INTEGER), CAST(0 AS INTEGER), 'вход которого соединен с выходом датчика', 'N_который_V_N', 'N0_который_V<F>_N', 'spec', CAST(2 AS INTEGER), '2', '2'),
('device', CAST(4 AS INTEGER), CAST(0 AS INTEGER), 'а выход блока подключен к индикатору', 'N_V_N', 'CC_N0_V<F>_N', 'self', CAST(0 AS INTEGER), NULL, NULL),
('device', CAST(5 AS INTEGER), CAST(0 AS INTEGER), 'он снабжен экраном', 'N_V_N', 'PR0_V<F>_N', 'self', CAST(0 AS INTEGER), NULL, NULL),
('filter', CAST(1 AS INTEGER), CAST(0 AS INTEGER), 'Фильтр', 'N', 'N0', 'self', CAST(0 AS INTEGER), NULL, NULL),
('filter', CAST(2 AS INTEGER), CAST(0 AS INTEGER), 'состоящий из корпуса и ротора с колесом', 'V_N', 'V<P>_N_CC_N', 'sub', CAST(1 AS INTEGER), '1', '1'),
('filter', CAST(3 AS INTEGER), CAST(0 AS INTEGER), 'предназначенного для очистки воды', 'PURPOSE', 'DROPPED', 'spec', CAST(2 AS INTEGER), '5', NULL),
('filter', CAST(4 AS INTEGER), CAST(0 AS INTEGER), 'корпус', 'N', 'N0', 'self', CAST(0 AS INTEGER), NULL, NULL),
('filter', CAST(5 AS INTEGER), CAST(0 AS INTEGER), 'имеющий отверстия', 'V_N', 'V<P>_N', 'sub', CAST(4 AS INTEGER), '1', '1'),
('filter', CAST(6 AS INTEGER), CAST(0 AS INTEGER), 'снабжен крышкой', 'V_N', 'V<F>_N', 'gap', CAST(4 AS INTEGER), '1', NULL),
('gear', CAST(1 AS INTEGER), CAST(1 AS INTEGER), 'Редуктор', 'N', 'N0', 'self', CAST(0 AS INTEGER), NULL, NULL),
('gear', CAST(2 AS INTEGER), CAST(1 AS INTEGER), 'включающий в себя корпус', 'V_N', 'V<P>_PR', 'sub', CAST(1 AS INTEGER), '1', '1'),
('gear', CAST(3 AS INTEGER), CAST(1 AS INTEGER), 'крышку', 'N', 'N0', 'homo', CAST(2 AS INTEGER), '1', '1'),
('gear', CAST(4 AS INTEGER), CAST(1 AS INTEGER), 'вал', 'N', 'N0', 'homo', CAST(2 AS INTEGER), '1', '1'),
('gear', CAST(5 AS INTEGER), CAST(1 AS INTEGER), 'причем вал соединен с валом двигателя через муфту', 'N_V_N', 'N0_V<F>_N0', 'self', CAST(0 AS INTEGER), NULL, NULL),
('gear', CAST(6 AS INTEGER), CAST(2 AS INTEGER), 'крышка закреплена на корпусе', 'N_V_N', 'N0_V<F>_N', 'self', CAST(0 AS INTEGER), NULL, NULL),
('gear', CAST(7 AS INTEGER), CAST(2 AS INTEGER), 'вал - на штоке', 'N_-_N', 'N0_-_N', 'dupl', CAST(6 AS INTEGER), '2', NULL),
('gear', CAST(8 AS INTEGER), CAST(2 AS INTEGER), 'для повышения надежности', 'PURPOSE', 'DROPPED', 'unkn', CAST(0 AS INTEGER), NULL, NULL),
('probe', CAST(1 AS INTEGER), CAST(0 AS INTEGER), 'Зонд', 'N', 'N0', 'self', CAST(0 AS INTEGER), NULL, NULL),
('probe', CAST(2 AS INTEGER), CAST(0 AS INTEGER), 'содержащий корпус', 'V_N', 'V<P>_N0', 'sub', CAST(1 AS INTEGER), '1', '1'),
('probe', CAST(3 AS INTEGER), CAST(0 AS INTEGER), 'в котором размещены датчик и антенна', 'который_V_N', 'который_V<F>_N0_CC_N0', 'spec', CAST(2 AS INTEGER), '2', '2'),
('probe', CAST(4 AS INTEGER), CAST(0 AS INTEGER), 'а также кабель диаметром 0,5 мм', 'N', 'N0', 'homo', CAST(3 AS INTEGER), '3', '3'),
('probe', CAST(5 AS INTEGER), CAST(0 AS INTEGER), 'соединенный с датчиком', 'V_N', 'V<P>_N', 'sub', CAST(4 AS INTEGER), '3', '1')) AS t("code", "id", "part", "text", "type", "template", "link", "parent", "point", "child")"""

CLAIM_EDGES_BY_NAME = r"""SELECT * FROM (VALUES
('case', 'блок', 'подключать', 'conn', 'насос'),
('case', 'блоки питания', 'размещать', 'conn', 'корпус'),
('case', 'изделие', 'содержать', 'comp', 'корпус'),
('case', 'корпус', 'выполнять', 'comp', 'цилиндр'),
('case', 'плата', 'размещать', 'conn', 'корпус'),
('device', 'блок', NULL, 'have', 'вход'),
('device', 'блок', NULL, 'have', 'выход'),
('device', 'вход', 'соединять', 'conn', 'выход датчика'),
('device', 'выход', 'подключать', 'conn', 'индикатор'),
('device', 'прибор', 'снабжать', 'comp', 'экран'),
('device', 'прибор', 'содержать', 'comp', 'блок'),
('filter', 'корпус', 'снабжать', 'comp', 'крышка'),
('filter', 'фильтр', 'состоять', 'comp', 'корпус'),
('filter', 'фильтр', 'состоять', 'comp', 'ротор с колесом'),
('gear', 'вал', 'закреплять', 'conn', 'шток'),
('gear', 'вал', 'соединять', 'conn', 'вал двигателя'),
('gear', 'крышка', 'закреплять', 'conn', 'корпус'),
('gear', 'редуктор', 'включать', 'comp', 'вал'),
('gear', 'редуктор', 'включать', 'comp', 'корпус'),
('gear', 'редуктор', 'включать', 'comp', 'крышка'),
('probe', 'антенна', 'размещать', 'conn', 'корпус'),
('probe', 'датчик', 'размещать', 'conn', 'корпус'),
('probe', 'зонд', 'содержать', 'comp', 'корпус'),
('probe', 'кабель диаметром 0,5 мм', 'размещать', 'conn', 'корпус'),
('probe', 'кабель диаметром 0,5 мм', 'соединять', 'conn', 'датчик')) AS t("code", "sbj", "verb", "type", "obj")"""

READ_PATENT_XML = r"""SELECT * FROM (VALUES
('a.xml', 'RU_01000001_C1_20200115', 'RU', '01000001', 'C1', '20200115', 'УСТРОЙСТВО 01000001', 'ООО Завод (RU)', CAST(['F16K1/00', 'F16L3/02'] AS VARCHAR[]), '1. Клапан (1), содержащий корпус и пружину, отличающийся тем, что корпус соединен с трубой, а пружина закреплена на штоке.', CAST(['1. Клапан (1), содержащий корпус и пружину, отличающийся тем, что корпус соединен с трубой, а пружина закреплена на штоке.', '2. Устройство по п.1.'] AS VARCHAR[]), CAST(['Клапан. Технический результат: увеличение срока службы пружины с помощью смазки.'] AS VARCHAR[]), CAST(['Изобретение относится к технике.', 'Техническим результатом изобретения является повышение надежности работы клапана.'] AS VARCHAR[]), NULL),
('b.xml', 'RU_01000002_C1_20200115', 'RU', '01000002', 'C1', '20200115', 'УСТРОЙСТВО 01000002', 'ООО Завод (RU)', CAST(['F16K1/00', 'F16L3/02'] AS VARCHAR[]), '1. Насос, включающий двигатель, вал & муфту, отличающийся тем, что вал связан с муфтой.', CAST(['1. Насос, включающий двигатель, вал & муфту, отличающийся тем, что вал связан с муфтой.', '2. Устройство по п.1.'] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST(['Изобретение относится к технике.', 'Техническим результатом изобретения является повышение надежности работы клапана.'] AS VARCHAR[]), NULL),
('c.xml', NULL, 'RU', '01000003', NULL, '20200115', 'УСТРОЙСТВО 01000003', 'ООО Завод (RU)', CAST(['F16K1/00', 'F16L3/02'] AS VARCHAR[]), '1. Насос, включающий двигатель, вал & муфту, отличающийся тем, что вал связан с муфтой.', CAST(['1. Насос, включающий двигатель, вал & муфту, отличающийся тем, что вал связан с муфтой.', '2. Устройство по п.1.'] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST(['Изобретение относится к технике.', 'Техническим результатом изобретения является повышение надежности работы клапана.'] AS VARCHAR[]), 'no code'),
('d.xml', NULL, NULL, NULL, NULL, NULL, NULL, NULL, CAST([] AS VARCHAR[]), NULL, CAST(NULL AS VARCHAR[]), CAST(NULL AS VARCHAR[]), CAST(NULL AS VARCHAR[]), 'not a patent'),
('e.xml', NULL, NULL, NULL, NULL, NULL, NULL, NULL, CAST([] AS VARCHAR[]), NULL, CAST(NULL AS VARCHAR[]), CAST(NULL AS VARCHAR[]), CAST(NULL AS VARCHAR[]), 'broken XML')) AS t("path", "code", "country", "doc_number", "kind", "date_publ", "name", "org", "ipc", "main_claim", "claims", "abstract", "description", "error")"""

CLAIM_RECORDS = r"""SELECT * FROM (VALUES
('RU_01000001_C1_20200115', 'УСТРОЙСТВО 01000001', 'ООО Завод (RU)', CAST(['F16K1/00', 'F16L3/02'] AS VARCHAR[]), CAST(4 AS INTEGER), CAST(5 AS INTEGER), CAST(2 AS INTEGER)),
('RU_01000002_C1_20200115', 'УСТРОЙСТВО 01000002', 'ООО Завод (RU)', CAST(['F16K1/00', 'F16L3/02'] AS VARCHAR[]), CAST(4 AS INTEGER), CAST(4 AS INTEGER), CAST(1 AS INTEGER))) AS t("code", "name", "org", "ipc", "n_segments", "n_terms", "n_facts")"""

CLAIM_GRAPH_EDGES = r"""SELECT * FROM (VALUES
('RU_01000001_C1_20200115', '2.2', '0.0', '2.1', CAST(0 AS INTEGER), 'comp', CAST(0 AS INTEGER)),
('RU_01000001_C1_20200115', '2.4', '0.0', '2.1', CAST(0 AS INTEGER), 'comp', CAST(1 AS INTEGER)),
('RU_01000001_C1_20200115', '3.4', '2.2', '3.2', CAST(1 AS INTEGER), 'conn', CAST(2 AS INTEGER)),
('RU_01000001_C1_20200115', '4.5', '2.4', '4.3', CAST(1 AS INTEGER), 'conn', CAST(3 AS INTEGER)),
('RU_01000002_C1_20200115', '2.2', '0.0', '2.1', CAST(0 AS INTEGER), 'comp', CAST(0 AS INTEGER)),
('RU_01000002_C1_20200115', '3.1', '0.0', '2.1', CAST(0 AS INTEGER), 'comp', CAST(1 AS INTEGER)),
('RU_01000002_C1_20200115', '3.3', '0.0', '2.1', CAST(0 AS INTEGER), 'comp', CAST(2 AS INTEGER)),
('RU_01000002_C1_20200115', '3.3', '3.1', '4.2', CAST(1 AS INTEGER), 'conn', CAST(3 AS INTEGER))) AS t("code", "obj_key", "sbj_key", "verb_key", "prep_key", "type", "ord")"""

CLAIM_FACTS = r"""SELECT * FROM (VALUES
('RU_01000001_C1_20200115', CAST(1 AS INTEGER), 'увеличение', 'срока службы пружины', 'с помощью смазки'),
('RU_01000001_C1_20200115', CAST(2 AS INTEGER), 'повышение', 'надежности работы клапана', NULL),
('RU_01000002_C1_20200115', CAST(1 AS INTEGER), 'повышение', 'надежности работы клапана', NULL)) AS t("code", "n", "action", "object", "condit")"""

CLAIM_RDF = r"""SELECT * FROM (VALUES
('RU_01000001_C1_20200115', 'RU_01000001_C1_20200115_com_0', 'concept_name', 'корпус', 'literal'),
('RU_01000001_C1_20200115', 'RU_01000001_C1_20200115_com_0', 'connected_to', 'RU_01000001_C1_20200115_com_2', 'iri'),
('RU_01000001_C1_20200115', 'RU_01000001_C1_20200115_com_0', 'part_of', 'RU_01000001_C1_20200115_dev_0', 'iri'),
('RU_01000001_C1_20200115', 'RU_01000001_C1_20200115_com_0', 'rdf:type', 'Component', 'iri'),
('RU_01000001_C1_20200115', 'RU_01000001_C1_20200115_com_1', 'concept_name', 'пружина', 'literal'),
('RU_01000001_C1_20200115', 'RU_01000001_C1_20200115_com_1', 'connected_to', 'RU_01000001_C1_20200115_com_3', 'iri'),
('RU_01000001_C1_20200115', 'RU_01000001_C1_20200115_com_1', 'part_of', 'RU_01000001_C1_20200115_dev_0', 'iri'),
('RU_01000001_C1_20200115', 'RU_01000001_C1_20200115_com_1', 'rdf:type', 'Component', 'iri'),
('RU_01000001_C1_20200115', 'RU_01000001_C1_20200115_com_2', 'concept_name', 'труба', 'literal'),
('RU_01000001_C1_20200115', 'RU_01000001_C1_20200115_com_2', 'part_of', 'RU_01000001_C1_20200115_dev_0', 'iri'),
('RU_01000001_C1_20200115', 'RU_01000001_C1_20200115_com_2', 'rdf:type', 'Component', 'iri'),
('RU_01000001_C1_20200115', 'RU_01000001_C1_20200115_com_3', 'concept_name', 'шток', 'literal'),
('RU_01000001_C1_20200115', 'RU_01000001_C1_20200115_com_3', 'part_of', 'RU_01000001_C1_20200115_dev_0', 'iri'),
('RU_01000001_C1_20200115', 'RU_01000001_C1_20200115_com_3', 'rdf:type', 'Component', 'iri'),
('RU_01000001_C1_20200115', 'RU_01000001_C1_20200115_dev_0', 'concept_name', 'клапан', 'literal'),
('RU_01000001_C1_20200115', 'RU_01000001_C1_20200115_dev_0', 'contains', 'RU_01000001_C1_20200115_com_0', 'iri'),
('RU_01000001_C1_20200115', 'RU_01000001_C1_20200115_dev_0', 'contains', 'RU_01000001_C1_20200115_com_1', 'iri'),
('RU_01000001_C1_20200115', 'RU_01000001_C1_20200115_dev_0', 'doc_name', 'УСТРОЙСТВО 01000001', 'literal'),
('RU_01000001_C1_20200115', 'RU_01000001_C1_20200115_dev_0', 'doc_num', 'RU_01000001_C1_20200115', 'literal'),
('RU_01000001_C1_20200115', 'RU_01000001_C1_20200115_dev_0', 'doc_org', 'ООО Завод (RU)', 'literal'),
('RU_01000001_C1_20200115', 'RU_01000001_C1_20200115_dev_0', 'has_ipc', 'RU_01000001_C1_20200115_ipc_0', 'iri'),
('RU_01000001_C1_20200115', 'RU_01000001_C1_20200115_dev_0', 'rdf:type', 'Device', 'iri'),
('RU_01000001_C1_20200115', 'RU_01000001_C1_20200115_dev_0', 'solution_for', 'RU_01000001_C1_20200115_pbl_1', 'iri'),
('RU_01000001_C1_20200115', 'RU_01000001_C1_20200115_dev_0', 'solution_for', 'RU_01000001_C1_20200115_pbl_2', 'iri'),
('RU_01000001_C1_20200115', 'RU_01000001_C1_20200115_ipc_0', 'ipc_code', 'F16K1/00', 'literal'),
('RU_01000001_C1_20200115', 'RU_01000001_C1_20200115_ipc_0', 'ipc_code', 'F16L3/02', 'literal'),
('RU_01000001_C1_20200115', 'RU_01000001_C1_20200115_ipc_0', 'rdf:type', 'IPC', 'iri'),
('RU_01000001_C1_20200115', 'RU_01000001_C1_20200115_pbl_1', 'problem_name', 'увеличение срока службы пружины с помощью смазки', 'literal'),
('RU_01000001_C1_20200115', 'RU_01000001_C1_20200115_pbl_1', 'rdf:type', 'Problem', 'iri'),
('RU_01000001_C1_20200115', 'RU_01000001_C1_20200115_pbl_2', 'problem_name', 'повышение надежности работы клапана', 'literal'),
('RU_01000001_C1_20200115', 'RU_01000001_C1_20200115_pbl_2', 'rdf:type', 'Problem', 'iri'),
('RU_01000002_C1_20200115', 'RU_01000002_C1_20200115_com_0', 'concept_name', 'двигатель', 'literal'),
('RU_01000002_C1_20200115', 'RU_01000002_C1_20200115_com_0', 'part_of', 'RU_01000002_C1_20200115_dev_0', 'iri'),
('RU_01000002_C1_20200115', 'RU_01000002_C1_20200115_com_0', 'rdf:type', 'Component', 'iri'),
('RU_01000002_C1_20200115', 'RU_01000002_C1_20200115_com_1', 'concept_name', 'вал', 'literal'),
('RU_01000002_C1_20200115', 'RU_01000002_C1_20200115_com_1', 'connected_to', 'RU_01000002_C1_20200115_com_2', 'iri'),
('RU_01000002_C1_20200115', 'RU_01000002_C1_20200115_com_1', 'part_of', 'RU_01000002_C1_20200115_dev_0', 'iri'),
('RU_01000002_C1_20200115', 'RU_01000002_C1_20200115_com_1', 'rdf:type', 'Component', 'iri'),
('RU_01000002_C1_20200115', 'RU_01000002_C1_20200115_com_2', 'concept_name', 'муфта', 'literal'),
('RU_01000002_C1_20200115', 'RU_01000002_C1_20200115_com_2', 'part_of', 'RU_01000002_C1_20200115_dev_0', 'iri'),
('RU_01000002_C1_20200115', 'RU_01000002_C1_20200115_com_2', 'rdf:type', 'Component', 'iri'),
('RU_01000002_C1_20200115', 'RU_01000002_C1_20200115_dev_0', 'concept_name', 'насос', 'literal'),
('RU_01000002_C1_20200115', 'RU_01000002_C1_20200115_dev_0', 'contains', 'RU_01000002_C1_20200115_com_0', 'iri'),
('RU_01000002_C1_20200115', 'RU_01000002_C1_20200115_dev_0', 'contains', 'RU_01000002_C1_20200115_com_1', 'iri'),
('RU_01000002_C1_20200115', 'RU_01000002_C1_20200115_dev_0', 'contains', 'RU_01000002_C1_20200115_com_2', 'iri'),
('RU_01000002_C1_20200115', 'RU_01000002_C1_20200115_dev_0', 'doc_name', 'УСТРОЙСТВО 01000002', 'literal'),
('RU_01000002_C1_20200115', 'RU_01000002_C1_20200115_dev_0', 'doc_num', 'RU_01000002_C1_20200115', 'literal'),
('RU_01000002_C1_20200115', 'RU_01000002_C1_20200115_dev_0', 'doc_org', 'ООО Завод (RU)', 'literal'),
('RU_01000002_C1_20200115', 'RU_01000002_C1_20200115_dev_0', 'has_ipc', 'RU_01000002_C1_20200115_ipc_0', 'iri'),
('RU_01000002_C1_20200115', 'RU_01000002_C1_20200115_dev_0', 'rdf:type', 'Device', 'iri'),
('RU_01000002_C1_20200115', 'RU_01000002_C1_20200115_dev_0', 'solution_for', 'RU_01000002_C1_20200115_pbl_1', 'iri'),
('RU_01000002_C1_20200115', 'RU_01000002_C1_20200115_ipc_0', 'ipc_code', 'F16K1/00', 'literal'),
('RU_01000002_C1_20200115', 'RU_01000002_C1_20200115_ipc_0', 'ipc_code', 'F16L3/02', 'literal'),
('RU_01000002_C1_20200115', 'RU_01000002_C1_20200115_ipc_0', 'rdf:type', 'IPC', 'iri'),
('RU_01000002_C1_20200115', 'RU_01000002_C1_20200115_pbl_1', 'problem_name', 'повышение надежности работы клапана', 'literal'),
('RU_01000002_C1_20200115', 'RU_01000002_C1_20200115_pbl_1', 'rdf:type', 'Problem', 'iri')) AS t("code", "s", "p", "o", "o_kind")"""

SEGMENT_DOT = r"""SELECT * FROM (VALUES
('RU_01000001_C1_20200115', 'digraph {' || chr(10) || '"1" [label="[1:N] Клапан"];' || chr(10) || '"0" -> "1";' || chr(10) || '"2" [label="[2:V_N] содержащий корпус и пружину"];' || chr(10) || '"1" -> "2";' || chr(10) || '"3" [label="[3:N_V_N] корпус соединен с трубой"];' || chr(10) || '"0" -> "3";' || chr(10) || '"4" [label="[4:N_V_N] а пружина закреплена на штоке"];' || chr(10) || '"0" -> "4";' || chr(10) || '}'),
('RU_01000002_C1_20200115', 'digraph {' || chr(10) || '"1" [label="[1:N] Насос"];' || chr(10) || '"0" -> "1";' || chr(10) || '"2" [label="[2:V_N] включающий двигатель"];' || chr(10) || '"1" -> "2";' || chr(10) || '"3" [label="[3:N] вал & муфту"];' || chr(10) || '"2" -> "3";' || chr(10) || '"4" [label="[4:N_V_N] вал связан с муфтой"];' || chr(10) || '"0" -> "4";' || chr(10) || '}')) AS t("code", "dot")"""

GRAPH_DOT = r"""SELECT * FROM (VALUES
('RU_01000001_C1_20200115', 'digraph {' || chr(10) || '"0.0" -> "2.2" [style=solid];' || chr(10) || '"0.0" -> "2.4" [style=solid];' || chr(10) || '"0.0" [label="клапан", color=red];' || chr(10) || '"2.2" -> "3.4" [style=dashed];' || chr(10) || '"2.2" [label="корпус", color=yellow];' || chr(10) || '"2.4" -> "4.5" [style=dashed];' || chr(10) || '"2.4" [label="пружина", color=yellow];' || chr(10) || '"3.4" [label="труба", color=lime];' || chr(10) || '"4.5" [label="шток", color=lime];' || chr(10) || '}'),
('RU_01000002_C1_20200115', 'digraph {' || chr(10) || '"0.0" -> "2.2" [style=solid];' || chr(10) || '"0.0" -> "3.1" [style=solid];' || chr(10) || '"0.0" -> "3.3" [style=solid];' || chr(10) || '"0.0" [label="насос", color=red];' || chr(10) || '"2.2" [label="двигатель", color=yellow];' || chr(10) || '"3.1" -> "3.3" [style=dashed];' || chr(10) || '"3.1" [label="вал", color=yellow];' || chr(10) || '"3.3" [label="муфта", color=yellow];' || chr(10) || '}')) AS t("code", "dot")"""
