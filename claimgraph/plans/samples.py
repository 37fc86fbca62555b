"""Small invented patents for examples and tests."""

from __future__ import annotations


def patent(number: str, claim: str, abstract: str = "", kind: str | None = "C1") -> str:
    k = "" if kind is None else f' kind="{kind}"'
    return f"""<?xml version="1.0" encoding="UTF-8"?>
<!DOCTYPE ru-patent-document SYSTEM "ru-patent-document.dtd">
<ru-patent-document lang="ru" doc-number="{number}" country="RU"{k} date-publ="20200115">
<SDOBI lang="ru"><B500><B510EP><classification-ipcr><section>F</section><class>16</class><subclass>K</subclass><main-group>1</main-group><subgroup>00</subgroup></classification-ipcr>
<classification-ipcr><section>F</section><class>16</class><subclass>L</subclass><main-group>3</main-group><subgroup>02</subgroup></classification-ipcr></B510EP><ru-b540><ru-b542>УСТРОЙСТВО {number}</ru-b542></ru-b540></B500>
<B700><B730><B731><ru-name-text>ООО Завод (RU)</ru-name-text></B731></B730></B700></SDOBI>
<description lang="ru"><p num="1">Изобретение относится к технике.</p><p num="2">Техническим результатом изобретения является повышение надежности работы клапана.</p></description>
<claims lang="ru"><claim num="1"><claim-text>{claim}</claim-text></claim><claim num="2"><claim-text>2. Устройство по п.1.</claim-text></claim></claims>
<abstract lang="ru"><p num="3">{abstract}</p></abstract></ru-patent-document>"""


CLAIM_1 = "1. Клапан (1), содержащий корпус и пружину, отличающийся тем, что корпус соединен с трубой, а пружина закреплена на штоке."
CLAIM_2 = "1. Насос, включающий двигатель, вал &amp; муфту, отличающийся тем, что вал связан с муфтой."
PATENTS = [
    ("a.xml", patent("01000001", CLAIM_1, "Клапан. Технический результат: увеличение срока службы пружины с помощью смазки.")),
    ("b.xml", patent("01000002", CLAIM_2)),
    ("c.xml", patent("01000003", CLAIM_2, kind=None)),
    ("d.xml", "<other-document><a/></other-document>"),
    ("e.xml", patent("01000005", CLAIM_1)[:-30]),
]
#: Invented claims with the constructions that links and triplets are made for.
CLAIMS = [
    ("probe", "1. Зонд, содержащий корпус, в котором размещены датчик и антенна, а также кабель диаметром 0,5 мм, соединенный с датчиком."),
    ("gear", "1. Редуктор, включающий в себя корпус, крышку, вал, причем вал соединен с валом двигателя через муфту, отличающийся тем, что крышка закреплена на корпусе, вал - на штоке, для повышения надежности."),
    ("filter", "1. Фильтр, состоящий из корпуса и ротора с колесом, предназначенного для очистки воды, корпус, имеющий отверстия, снабжен крышкой."),
    ("device", "1. Прибор, содержащий блок, вход которого соединен с выходом датчика, а выход блока подключен к индикатору, он снабжен экраном."),
    ("case", "1. Изделие, содержащее корпус, выполненный в виде цилиндра, в котором размещены плата, блоки питания, характеризующееся тем, что блок подключен к насосу."),
]
