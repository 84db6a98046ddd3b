"""English given names, as people write them."""

from __future__ import annotations

# English given names and their short forms.
NICKNAMES = """
alexander alex sasha al xander sandy
andre andre dre andy
andrew andy drew
anthony tony
benjamin ben benji benny
catherine cathy kate cat
charles charlie chuck chas
christina chris tina chrissie
christopher chris topher kit
daniel dan danny
david dave davy
edward ed eddie ted ned
eleanor ellie nell nora elle
elizabeth liz beth eliza betty lizzie libby
frederick fred freddy freddie
gabriella gabi ella gabby
gregory greg
heloise helo elo
henry harry hank
james jim jimmy jamie
jennifer jen jenny
john jack johnny
jonathan jon
joseph joe joey
josephine jo josie
katherine kate kathy katie kit
leonard leo len lenny
margaret maggie peggy meg greta
matthew matt
michael mike mick mickey
nathaniel nate nat nathan
nicholas nick nicky
patricia pat tricia
penelope penny nell
rebecca becky becca
reginald reg reggie
richard rick dick rich ricky
robert bob rob bobby robbie bert
samuel sam
sebastian seb bas bastian
stephen steve
susan sue
theodore theo ted teddy
thomas tom tommy
valentina val tina
victoria vicky tori
william bill will billy willy liam
zachary zach
zoe zoe
"""
# Further frequent given names.
OTHERS = """
aaron abigail adam albert alice amanda amy andrea angela anna anne arthur ashley barbara brandon brenda brian bruce carl carol caroline carolyn cheryl clara craig cynthia deborah debra dennis diana diane donald donna
dorothy douglas emily emma eric ethan eugene evelyn frances frank gary george gerald gloria grace hannah harold heather helen howard ian irene isaac jacob janet janice jason jean jeffrey jeremy jerry jesse jessica joan joyce
juan judith judy julia julie justin karen karl keith kelly kenneth kevin kimberly kyle larry laura lauren lawrence lee linda lisa logan louis lucas lucy madison maria marie marilyn mark martha martin mary megan melissa michelle
mildred monica nancy nathan neil noah nora oliver olivia oscar pamela patrick paul paula peter philip rachel ralph raymond rose roger ronald roy russell ruth ryan sandra sara sarah scott sean sharon shirley simon sophia
stanley stephanie steven teresa terry timothy todd tracy tyler vanessa vincent virginia walter wayne wendy
"""
GIVEN_NAMES = frozenset(NICKNAMES.split()) | frozenset(OTHERS.split())
