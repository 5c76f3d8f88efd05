"""Literal inputs for the query-analysis operators: the test tables hold invented words that none of them meets."""

from __future__ import annotations

#: (qid, text)
QUERIES = [
    (1, "Que dice la demanda de VALDERRAMA en la carpeta Molinos?"),
    (2, "mandame el Expte. 88412/2031 y el N° 640218"),
    (3, "hola"),
    (4, "no dije Molinos, quise decir otra cosa"),
    (5, "Explicame la cláusula novena"),
    (6, "gracias dale"),
    (7, "FMZ 73310/2032 contra OLMEDO y OLMEDO, numero 557301"),
    (8, "el segundo"),
    (9, "Redactame una contestación de demanda"),
    (10, "un caso cualquiera"),
    (11, "No pregunté por el puente. yo no hablé de Taller Oeste."),
    (12, "listar carpeta Faros para revisar"),
    (13, "Áéíóú   Ñandú  Über"),
    (14, "ok?!"),
    (15, "buenas tardes"),
    (16, "planilla 73310 y 733104 sueltas"),
    (17, "PARA CADA TODOS QUIROGA"),
    (18, "prepara un oficio para el puerto"),
    (19, "el saldo es 90.117/2033 segun CUIT 30998877665"),
    (20, "¿Cuál es la regla del artículo 44?"),
    (21, "Expediente AB-12/9."),
    (22, "CUIJ 13-0655; expte 13-0655"),
    (23, "N 4455"),
    (24, "cinco 12345 y otra vez 12345"),
    (25, "yo no quise decir sobre Viento Norte!"),
    (26, "no dije eso"),
    (27, "dentro de la carpeta Lanas Finas, buscame algo"),
    (28, "de documentos Viejos traeme lo ultimo"),
    (29, "ampliá el detalle de ese caso"),
    (30, "¿qué es un oficio? definicion"),
    (31, ""),
    (32, "no"),
]

#: (folder)
FOLDERS = [("Molinos",), ("Documentos Faros",), ("Deposito",), ("Lanas Finas",), ("Viento del Norte",)]

#: (qid, raw): one or more for each rule
ASKED = [
    (1, "molinos"),
    (2, "FÁROS"),
    (3, "documentos"),
    (4, "lamas finaz"),
    (5, "zzz"),
    (6, "depositos viejos"),
    (7, "finas telas"),
    (8, "norteño del viento"),
    (9, "xx molin yy"),
    (10, "xx olino"),
    (11, "depsito"),
    (12, "a"),
    (13, "lan"),
    (14, "qq posit ww"),
    (15, "vientos"),
]

#: (conv, turn, carpeta, expedientes, nombres, negated)
CONTEXTS = [
    (1, 0, "Molinos", ["88412"], ["VALDERRAMA"], []),
    (1, 1, None, [], [], []),
    (1, 2, None, ["557301"], [], ["valderrama"]),
    (1, 3, None, [], [], ["Molinos"]),
    (2, 0, None, [], ["OLMEDO"], ["olmedo"]),
    (2, 1, "Faros", [], [], ["faros"]),
    (2, 2, "Lanas", [], [], []),
    (3, 0, "Deposito", ["1", "22222"], [], []),
    (3, 1, None, [], ["QUIROGA"], ["22222 y mas"]),
    (3, 2, None, ["33333"], ["SORIA"], []),
    (3, 3, None, [], [], ["soria", "quiroga"]),
    (4, 0, None, [], [], []),
    (4, 1, None, [], [], ["nada"]),
]

#: (conv, turn, text): conversations for the whole analysis, against FOLDERS
TURNS = [
    (1, 0, "que hay en la carpeta molinos sobre la demanda de VALDERRAMA N° 640218"),
    (1, 1, "dame el segundo"),
    (1, 2, "y el Expte. 88412/2031?"),
    (1, 3, "no dije molinos, seguí"),
    (1, 4, "¿qué es la regla?"),
    (2, 0, "los casos de Lanas Finas"),
    (2, 1, "ahora OLMEDO"),
    (2, 2, "yo no hablé de olmedo."),
    (2, 3, "en la carpeta farols busca planos"),
    (2, 4, "   "),
    (2, 5, "otro"),
    (3, 0, ""),
    (3, 1, "definicion de oficio y del escrito"),
    (3, 2, "carpeta Inventada para ver"),
    (3, 3, "todo de viento del norte y lanas finas"),
    (4, 0, "mirá el depósito: 73310 y 733104"),
    (4, 1, "depositos"),
    (4, 2, "no pregunté por 73310, gracias"),
    (5, 0, "hola"),
    (5, 1, None),
    (5, 2, "PARA TODOS QUIROGA"),
    (5, 3, "cual es el articulo 44"),
]

#: (aid, answer)
ANSWERS = [
    (1, "Segun (acuerdo.pdf, pag. 3) y (PLANO (7).pdf, pag 12) vale."),
    (1, "Ver (ajeno.docx pág. 7)."),
    (2, "Nada que citar (sin archivo, pag. 2)."),
    (3, "(Informe Anual.txt, PAG. 9); (acuerdo.pdf, pag.4)"),
    (4, "Sin nada."),
    (5, "(a.doc, pag. 1)(a.doc, pag. 2) (A.DOC, pag. 3)"),
    (6, "(lista, a.pdf, pag. 1) (b.xls, pag. 1) (c.pdf, pag. x)"),
]

#: (aid, filename)
CITED = [(1, "ACUERDO.pdf"), (1, "plano (7).PDF"), (3, "informe anual.txt"), (2, "x.pdf"), (5, "a.doc"), (6, "a.pdf")]

#: (cid, cited, paths)
TOLERANT = [
    (1, "Plánó 7.pdf", ["/a/plano 7.pdf"]),
    (2, "acuerdo", ["/a/b.pdf", "/x/Acuerdo  final.pdf"]),
    (3, "", ["/a/b.pdf"]),
    (4, "anexo completo de acuerdo.pdf", ["/z/acuerdo.pdf"]),
    (5, "nada.pdf", ["/z/acuerdo.pdf"]),
]

#: (filename, rank)
NAMED = [("modelo.pdf", 1), ("Expte 12 Soria.pdf", 2), ("Olmedo c/Puerto.docx", 3), ("notas.txt", 4), ("Luna vs Vega.pdf", 5), ("N° 4 acta.pdf", 6), ("x123456.pdf", 7), ("Expediente.doc", 8)]

#: (lid, line)
LINES = [(1, "# Titulo"), (2, "### Tercero  "), (3, "- punto"), (4, "* otro"), (5, "1. uno"), (6, "2) dos"), (7, "EN MAYUSCULAS"), (8, "AB"), (9, "texto **fuerte**"), (10, ""), (11, "   "), (12, "#sin espacio"), (13, "12345678")]

#: (path, mtime, size): listed files and known ones around the tolerance of 1 ms
LISTED = [("/a/x.pdf", 1000.0, 10), ("/a/x.pdf", 1000.0005, 10), ("/a/x.pdf", 1000.5, 10), ("/b/y.txt", 5.0, 7), ("/b/new.doc", 9.0, 1)]
KNOWN = [("/a/x.pdf", 1000.0, 10), ("/b/y.txt", 5.0, 8)]

#: (uid, url, whether it is valid)
IMAGES = [
    (1, "https://a.example/x.png", True),
    (2, "http:///nohost", False),
    (3, "ftp://a.example/x.png", False),
    (4, "data:image/png;base64,iVBORw0KGgoAAAA=", True),
    (5, "data:image/jpeg;base64,iVBORw0KGgoAAAA=", False),
    (6, "data:image/JPG;base64,/9j/4AAQ", True),
    (7, "data:image/gif;base64,R0lGODlhAQAB", True),
    (8, "data:image/webp;base64,UklGRgAAAABXRUJQ", True),
    (9, "data:image/avif;base64,AAAAHGZ0eXBhdmlm", True),
    (10, "data:image/png;base64,@@@", False),
    (11, "", False),
    (12, None, False),
]


#: (qid, ord, text): variants of requests, with bullets, too short and too long ones, and more than count
VARIANTS = [(1, 1, "- molinos y demanda"), (1, 2, "ab"), (1, 3, "x" * 201), (1, 4, "* harina del Molino"), (1, 5, "• trigo"), (1, 6, "cuarta que sobra"), (2, 1, "  "), (9, 1, "sin pregunta")]
ASKING = [(1, "que dice la demanda del molino"), (2, "hola")]

#: (qid, rank, filename, page, channel, snippet, path, score, context)
HITS = [
    (1, 1, "acuerdo.pdf", 3, "semantic", "el acuerdo dice", "/m/acuerdo.pdf", 0.876, "texto uno"),
    (1, 2, "plano.pdf", 0, "filename:plano", "p" * 310, "/m/plano.pdf", 1.5, "texto dos"),
    (1, 3, None, 2, None, None, None, 1234.5, ""),
    (2, 1, "nota.txt", 1, "expte:88412", "nota", "/n/nota.txt", 1.8, "texto"),
]

#: (mid, parts): parts are (type, text, url, detail)
PNG = "data:image/png;base64,iVBORw0KGgoAAAA="
PARTS = [
    (1, [("text", "hola", None, None), ("image_url", None, PNG, "low"), ("image_url", None, "ftp://x.example/a.png", "low")]),
    (2, [("image_url", None, "https://x.example/a.png", "huge"), ("file", "secreto", None, None), ("text", None, None, None)]),
    (3, []),
    (4, [("image_url", "texto", PNG, None), ("text", "", PNG, "high"), (None, "x", None, None)]),
]


def spark_frame(spark, rows: list[tuple], schema: str):
    return spark.createDataFrame(rows, schema)


def sql_values(rows: list[tuple]) -> str:
    """The rows as a VALUES list for DuckDB."""

    def lit(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        if isinstance(v, list):
            return "CAST([" + ", ".join(map(lit, v)) + "] AS VARCHAR[])"
        return f"{v!r}::DOUBLE" if isinstance(v, float) else str(v)

    return "VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
