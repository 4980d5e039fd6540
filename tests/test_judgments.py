from __future__ import annotations

from lexquarry.operators import judgments as J

TEXT = """LAHORE HIGH COURT, LAHORE
Form HCJD
Criminal Revision No. 173 of 2024
CRIMINAL REVISIONS Nos. 174-B OF 2024 and Writ Petition No.9/2023
as held in Criminal Revision No.163/2023
NO.128 OF 2024
FIR No. 55/2021
(see W.P. No. 7 of 2020)
Muhammad  Aslam Petitioner…
Versus
The State -- Respondent
Present: Tariq Saleem Sheikh, J.
Mr. Justice Jamal Khan and Justice Jamal Khan sat. decided on: 12.03.2024.
(a) Penal Code, 1860---Ss. 302 & 34---held
Evidence Act, 1872--S. 5---more
(b) PENAL CODE, 1860---S. 9---again
""" + "text " * 300 + """bail granted. The appeal is  hereby dismissed.
(MUHAMMAD AZAM KHAN)
JUDGE"""


def test_fields():
    got = J.metadata(TEXT, [(n, J.re.compile(p, J.re.I)) for n, p in J.COURTS.items()])
    assert got["court"] == "Lahore High Court"
    assert got["case_nos"] == ["Criminal Revision No. 173/2024", "CRIMINAL REVISIONS Nos. 174-B/2024", "No.128/2024"]
    assert got["parties"] == "Muhammad Aslam Petitioner vs The State"
    assert got["judges"] == ["Justice Jamal Khan", "Tariq Saleem Sheikh", "Muhammad Azam Khan"]
    assert got["decided_on"] == "12.03.2024"
    assert got["statutes_cited"] == ["Penal Code, 1860", "Evidence Act, 1872"]
    assert got["disposition"] == "appeal is hereby dismissed"


def test_labels_and_dates():
    assert J.parties("APPLICANT : Saleem Khalid, through Mr. Adnan\nRESPONDENT: The State") == "Saleem Khalid vs The State"
    assert J.parties("PETITIONER: A B C") == "A B C" and J.parties("RESPONDENT: A B C") is None and J.parties("") is None
    assert J.decided_on("x 1.2.2020 y 03-04-2021 z") == "03-04-2021"
    assert J.decided_on("decided on 4th May, 2020 at noon") == "4th May, 2020"
    assert J.decided_on("decided on NaN and") is None and J.decided_on("") is None


def test_tables(spark):
    docs = spark.createDataFrame([(1, TEXT, "c"), (2, None, "c"), (3, "", "c")], "ord int, text string, court string")
    got = {r.ord: r for r in J.judgment_metadata(docs).collect()}
    assert got[1].court == "Lahore High Court" and got[2].judges == [] and got[3].parties is None and len(got) == 3
    assert J.judgment_metadata(docs, courts={"Some Court": "court, lahore"}).where("ord = 1").first().court == "Some Court"
    assert J.judgment_metadata(docs.limit(0)).count() == 0
