"""Pages in layouts that the module's own examples and LAYOUTS don't show, with the text that is to be found."""

A = "The first paragraph of the report tells in a few words what has happened, and where."
B = "A second one goes on about the people who were there, what they saw and what they think of it."
C = "Finally, the last paragraph looks ahead: nobody knows yet how it will end, but there is hope."
MENU = "<li><a href=/1>Home</a><li><a href=/2>World news</a><li><a href=/3>Sports</a>"
LINKS = "<a href=/1>Home</a> <a href=/2>World news</a> <a href=/3>Sports</a>"
COMMENT = "I was there myself and can tell you that it was quite different from what they write here."
FOOT = "<footer>&copy; 2020 The Paper, all rights reserved</footer>"
ALL = f"{A}\n{B}\n{C}"

PAGES = {
    "one div": (f"<body><div>{A}</div></body>", A),
    "two divs": (f"<body><div>{A}</div><div>{B}</div></body>", f"{A}\n{B}"),
    "heading and divs": (f"<body><h1>The report</h1><div>{A}</div><div>{B}</div><div>{C}</div></body>", f"The report\n{ALL}"),
    "section": (f"<body><section><h2>The report</h2><p>{A}</p><p>{B}</p></section>{FOOT}</body>", f"The report\n{A}\n{B}"),
    "sections": (f"<body><nav>{LINKS}</nav><section><p>{A}</p></section><section><p>{B}</p><p>{C}</p></section></body>", ALL),
    "list": (f"<body><ul>{MENU}</ul><ol><li>{A}<li>{B}<li>{C}</ol></body>", ALL),
    "table": (f"<body><table><tr><td>{LINKS}</td><td><p>{A}</p><p>{B}</p></td></tr></table></body>", f"{A}\n{B}"),
    "menu in a table": (f"<table><tr><td><a href=/1>Home</a></td><td><a href=/2>World news</a></td></tr></table><div><p>{A}</p><p>{B}</p></div>", f"{A}\n{B}"),
    "nested divs": (f"<body><div><div><ul>{MENU}</ul></div><div><div><p>{A}</p><p>{B}</p></div></div></div>{FOOT}</body>", f"{A}\n{B}"),
    "comments as ol": (f"<body><div><h1>The report</h1><p>{A}</p><p>{B}</p></div><ol class=responses><li>{COMMENT}<li>{COMMENT}</ol></body>", f"The report\n{A}\n{B}"),
    "comments in divs": (f"<body><div id=main><p>{A}</p><p>{B}</p></div><div id='commentlist'><div>{COMMENT}</div><div>{COMMENT}</div></div></body>", f"{A}\n{B}"),
    "plain paragraphs": (f"<body><p>{A}</p><p>{B}</p><p>{C}</p></body>", ALL),
    "links in text": (f"<body><div>{LINKS}</div><div><p>{A} <a href=/x>More about it</a> here.</p><p>{B}</p></div></body>", f"{A} More about it here.\n{B}"),
    "form and notice": (f"<body><div class='cookie-banner'><p>{COMMENT}</p></div><main><div>{A}</div><div>{B}</div></main><form><p>Your mail, please:</p></form></body>", f"{A}\n{B}"),
    "short paragraphs": (f"<body><div><p>{A}</p><p>Yes.</p><p>{B}</p><p>No, he said.</p></div><aside><p>{COMMENT}</p></aside></body>", f"{A}\nYes.\n{B}\nNo, he said."),
    "body text": (f"<body>{A}<p>{B}</p></body>", f"{A}\n{B}"),
    "menu list first": (f"<body><ul>{MENU}</ul><h1>The report</h1><p>{A}</p><p>{B}</p><ul>{MENU}</ul></body>", f"The report\n{A}\n{B}"),
    "blockquote": (f"<body><div class=wrap><p>{A}</p><blockquote>{B}</blockquote><p>{C}</p></div></body>", ALL),
}
